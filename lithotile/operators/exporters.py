"""Exports of nested records to flat Parquet, and their check by reading back."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import wkb
from ..sources import geojson


def _json(column: str, empty: str):  # noqa: ANN202
    return F.coalesce(F.to_json(F.col(column)), F.lit(empty)).alias(column)


def flat_nodes(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "type", "position.lat", "position.lng", *[f"metrics.{m}" for m in ("passengerThroughput", "averageDwellTime", "peakHour", "saturationLevel")], _json("connectedRoutes", "[]"))


def flat_corridors(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "startNode", "endNode", *[f"metrics.{m}" for m in ("fuelBurnRate", "idlingHotspotScore", "vehicleStressIndex", "averageSpeed", "peakFlowTime")], _json("geometry", "[]"))


def flat_vehicles(df: DataFrame) -> DataFrame:
    return df.select("id", "saccoId", "saccoName", "plateNumber", "capacity", "currentPosition.lat", "currentPosition.lng", "heading", "speed", "status", "lastUpdated")


def flat_cells(df: DataFrame) -> DataFrame:
    return df.select("cellId", "resolution", "center.lat", "center.lng", _json("properties", "{}"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Rows of FeatureCollections: id, type, geometry_type, geometry_wkt and a prop_ column for each property of any feature.

    Files are read by byte ranges (see sources/geojson); the names of properties are one distributed union, one row per name.
    """
    features = geojson.read_features(spark, path).select(F.col("text").alias("f"))
    get = lambda p: F.get_json_object("f", p)
    x = features.select(F.coalesce(get("$.id"), F.lit("")).alias("id"), F.coalesce(get("$.type"), F.lit("Feature")).alias("type"), F.coalesce(get("$.geometry.type"), F.lit("Unknown")).alias("geometry_type"), F.when(get("$.geometry").isNotNull(), wkb.geojson_wkt(get("$.geometry"))).alias("geometry_wkt"), F.from_json(get("$.properties"), "map<string,string>").alias("p"))
    keys = sorted(r.k for r in x.select(F.explode(F.map_keys("p")).alias("k")).distinct().toLocalIterator())
    return x.select("id", "type", "geometry_type", "geometry_wkt", *[F.col("p")[k].alias(f"prop_{k}") for k in keys])


def export(df: DataFrame, path: str, validate: bool = True, order: list[str] | None = None) -> int:
    """Snappy Parquet, each file sorted by the columns of order (nulls last) if given; with validate the files are checked. Returns the rows written."""
    out = df.sortWithinPartitions(*[F.asc_nulls_last(c) for c in order]) if order else df
    out.write.mode("overwrite").option("compression", "snappy").parquet(path)
    if not validate:
        return df.sparkSession.read.parquet(path).count()
    return validate_files(df.sparkSession, path, schema=df.schema, order=[(c, False) for c in order or ()], codec="snappy")


def file_report(spark: SparkSession, path: str, order: list[tuple[str, bool]] = ()) -> DataFrame:
    """file, rows, bytes and breaks of every Parquet file: breaks are rows that come after one they should precede.

    order: columns, and whether each falls; nulls are last. Files are read by many tasks; rows of a file are compared by their place in it.
    """
    found = spark.read.parquet(path)
    place = Window.partitionBy("file").orderBy("at")
    x = found.select(*[F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(order)], F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.row_index").alias("at"))
    broken, equal = F.lit(False), F.lit(True)
    for i, (_, falls) in enumerate(order):
        now, old = F.col(f"k{i}"), F.col(f"o{i}")
        wrong = F.when(now.isNull(), F.lit(False)).when(old.isNull(), F.lit(True)).otherwise((old < now) if falls else (old > now))
        broken, equal = broken | (equal & wrong), equal & old.eqNullSafe(now)
    x = x.withColumns({f"o{i}": F.lag(f"k{i}").over(place) for i in range(len(order))} | {"first": F.row_number().over(place) == 1})
    return x.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("bytes"), F.count_if(~F.col("first") & broken).alias("breaks"))


def validate_files(spark: SparkSession, path: str, *, schema: T.StructType | None = None, order: list[tuple[str, bool]] = (), codec: str | None = None) -> int:
    """The rows of a folder of Parquet files. ValueError if one can't be read to its end, has another schema or codec, or is out of order."""
    try:
        back = spark.read.parquet(path)
        names = [(f.name, f.dataType) for f in back.schema]
        if schema is not None and names != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"{path}: the schema read back differs")
        back.write.format("noop").mode("overwrite").save()  # every column of every row
        wrong = file_report(spark, path, order)
        bad = (F.col("breaks") > 0) | (F.lit(False) if codec is None else ~F.col("file").contains(f".{codec}."))
        total, first = wrong.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.min(F.when(bad, F.struct("file", "breaks")))).first()
    except (PySparkException, Py4JJavaError) as e:
        if not re.search("READ_FILE|READ_FOOTER|not a Parquet file", str(e)):
            raise
        raise ValueError(f"{path}: a file can't be read") from e
    if first is not None:
        raise ValueError(f"{first.file}: {first.breaks} rows out of order" if first.breaks else f"{first.file}: not {codec}")
    return total


def pascal_case(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"[^A-Za-z0-9]+", name) if w)
