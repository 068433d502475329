"""Checks of written files, flat exports, external tables and error envelopes."""

import glob
import uuid

import pytest
from pyspark.sql import functions as F

from lithotile.operators import exporters
from lithotile.operators import viewport as V
from lithotile.sources import lake


def test_good_and_bad_files(spark, tmp_path):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 101).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s")).repartition(3)
    good = str(tmp_path / "good")
    assert exporters.export(df, good, order=["k", "s"]) == 5000
    report = exporters.file_report(spark, good, [("k", False), ("s", False)]).collect()
    assert len(report) == 3 and sum(r["rows"] for r in report) == 5000 and all(r.breaks == 0 and r["bytes"] > 0 for r in report)
    assert exporters.validate_files(spark, good, order=[("k", False)]) == 5000
    for wrong in ({"order": [("k", True)]}, {"order": [("s", False)]}, {"codec": "zstd"}, {"schema": df.select("id").schema}):
        with pytest.raises(ValueError):
            exporters.validate_files(spark, good, **wrong)
    falling = str(tmp_path / "falling")
    df.sortWithinPartitions(F.desc("k"), F.asc_nulls_last("s")).write.parquet(falling)
    assert exporters.validate_files(spark, falling, order=[("k", True), ("s", False)]) == 5000
    one = glob.glob(f"{good}/*.parquet")[0]
    data = open(one, "rb").read()
    open(one, "wb").write(data[: len(data) // 2])  # truncated
    (tmp_path / "good" / f".{one.rsplit('/', 1)[1]}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="can't be read"):
        exporters.validate_files(spark, good)


def test_flat_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "A", "stop", (1.0, 2.0), (10, 1.5, "08:00", None), ["r1", "r2"]), ("n2", None, None, None, None, None)], "id string, name string, type string, position struct<lat: double, lng: double>, metrics struct<passengerThroughput: int, averageDwellTime: double, peakHour: string, saturationLevel: double>, connectedRoutes array<string>")
    corridors = spark.createDataFrame([("c1", "C", "n1", "n2", (1.0, 2.0, 3.0, 4.0, "17:00"), [[1.0, 2.0]])], "id string, name string, startNode string, endNode string, metrics struct<fuelBurnRate: double, idlingHotspotScore: double, vehicleStressIndex: double, averageSpeed: double, peakFlowTime: string>, geometry array<array<double>>")
    vehicles = spark.createDataFrame([("v1", "s1", "S", "KAA", 14, (1.5, 2.5), 90.0, 30.0, "moving", "2025-01-01")], "id string, saccoId string, saccoName string, plateNumber string, capacity int, currentPosition struct<lat: double, lng: double>, heading double, speed double, status string, lastUpdated string")
    for name, flat, first in (
        ("nodes", exporters.flat_nodes(nodes), ("n1", "A", "stop", 1.0, 2.0, 10, 1.5, "08:00", None, '["r1","r2"]')),
        ("corridors", exporters.flat_corridors(corridors), ("c1", "C", "n1", "n2", 1.0, 2.0, 3.0, 4.0, "17:00", "[[1.0,2.0]]")),
        ("vehicles", exporters.flat_vehicles(vehicles), ("v1", "s1", "S", "KAA", 14, 1.5, 2.5, 90.0, 30.0, "moving", "2025-01-01")),
    ):
        assert exporters.export(flat, str(tmp_path / name), order=["id"]) == flat.count()
        assert tuple(spark.read.parquet(str(tmp_path / name)).orderBy("id").first()) == first
    assert exporters.flat_nodes(nodes).filter("id = 'n2'").first()["connectedRoutes"] == "[]"


def test_external_table_is_read_in_ranges(spark):
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1, 1001).select(F.col("id").alias("ID"), (F.col("id") % 10).alias("KIND"))
    rows.write.format("jdbc").option("url", url).options(**driver).option("dbtable", "THINGS").save()
    df = lake.jdbc_table(spark, url, "THINGS", key="ID", parts=4, **driver)
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("ID")).first()[0] == 500500
    some = df.filter("KIND = 3").select("ID")
    assert some.count() == 100 and "EqualTo(KIND,3)" in some._jdf.queryExecution().executedPlan().toString()
    assert lake.jdbc_table(spark, url, "THINGS", **driver).rdd.getNumPartitions() == 1
    rows.limit(0).write.format("jdbc").option("url", url).options(**driver).option("dbtable", "NOTHING").save()
    assert lake.jdbc_table(spark, url, "NOTHING", key="ID", **driver).count() == 0


def test_error_envelopes():
    told = lambda e: V.error_envelope(e)["error"]["code"]
    assert told(V.QueryError("x", "ZOOM_GATE")) == "ZOOM_GATE" and told(ValueError("unknown dataset")) == "VALIDATION_ERROR" and told(FileNotFoundError("no lake")) == "NOT_FOUND"
    inner = V.error_envelope(RuntimeError("secret path"))["error"]
    assert inner["code"] == "INTERNAL_ERROR" and "secret" not in str(inner)
