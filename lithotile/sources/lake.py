"""The lake: its schema, scans, views, writer, manifest and tile reader."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, h3, scoring, wkb
from . import snapshots
from .registry import BUILDINGS, DATASETS, BuildingDataset, Dataset, lake_root, view_name
from .shared import bounded_join

_SHARED = (
    "feature_id string, feature_type string, geometry binary, centroid_lat double, centroid_lng double, country_code string, h3_7 string, h3_8 string, h3_9 string, h3_10 string, "
    "tile_z int, tile_x int, tile_y int, zorder_key long, entropy_bucket int, cell_variance float, importance_byte tinyint, entropy_score float, compressed_size_bytes long, partition_run_id string"
)
_OSM = "highway string, building string, amenity string, landuse string, population int, road_class tinyint"
_BUILDING = "floorspace string, occupancy string, height_raw string, height_m double, height_floors double, quadkey string, relation_id string, source_provider string, area_m2 double, perimeter_m double"
_TYPES = {"string": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "tinyint": T.ByteType()}
LOCKED = T.StructType([T.StructField(c.split()[0], _TYPES[c.split()[1]]) for c in f"{_SHARED}, {_OSM}, {_BUILDING}".split(", ")])
_STORED = T.StructType([*LOCKED.fields, *[T.StructField(f"p_tile_{c}", T.IntegerType()) for c in "zxy"], T.StructField("p_run", T.StringType())])
SHARED_COLUMNS = [c.split()[0] for c in _SHARED.split(", ")]
OSM_COLUMNS = SHARED_COLUMNS + [c.split()[0] for c in _OSM.split(", ")]
BUILDING_COLUMNS = SHARED_COLUMNS + [c.split()[0] for c in _BUILDING.split(", ")]
RAW_BUILDING_COLUMNS = ["id", "floorspace", "occupancy", "relation_id", "quadkey", "last_update", "height", "geometry", "bbox", "source"]
TILE = ["tile_z", "tile_x", "tile_y"]
PARTITIONS = [f"p_{c}" for c in TILE]
RUN = "p_run"
BUDGET = {"maxImmediateBytes": 50_000_000, "maxBackgroundBytes": 200_000_000}


def locked(df: DataFrame) -> DataFrame:
    """Exactly the lake's columns, in order and type; columns that are missing are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOCKED])


def scan_lake(spark: SparkSession, path: str, tiles: Column | None = None) -> DataFrame:
    """The features of a lake's current version. tiles is a predicate on the partition columns p_tile_z, p_tile_x and p_tile_y: it prunes directories.

    A version that one run wrote whole is a filter on its partition; else the table of live tiles is joined to the partitions.
    """
    version = snapshots.current(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} holds no lake")
    found = spark.read.schema(_STORED).parquet(path)
    found = found if tiles is None else found.filter(tiles)
    found = found.filter(F.col(RUN).isin(version["runs"]))
    if not version["whole"]:
        live = live_tiles(spark, path).select(*[F.col(c).alias(f"p_{c}") for c in TILE], RUN)
        found = bounded_join(found, live, [*PARTITIONS, RUN], "left_semi")
    return locked(found)


def live_tiles(spark: SparkSession, path: str) -> DataFrame:
    """One row per tile of the current version: its run, feature_count, size_bytes, entropy, run_id, fetch_priority and tile_path."""
    return spark.read.parquet(f"{path.rstrip('/')}/_tiles/{snapshots.current(spark, path)['run']}")


def scan_features(spark: SparkSession, dataset: Dataset, tiles: Column | None = None) -> DataFrame:
    """The 26 columns of map features; the buildings below the same root are left out by their path."""
    return scan_lake(spark, features_path(dataset), tiles).select(*OSM_COLUMNS)


def features_path(dataset: Dataset) -> str:
    return f"{dataset.base_path.rstrip('/')}/features"


def scan_buildings(spark: SparkSession, dataset: BuildingDataset, enriched: bool | None = None, tiles: Column | None = None) -> DataFrame:
    if dataset.h3_enriched if enriched is None else enriched:
        return scan_lake(spark, dataset.enriched_path(), tiles).select(*BUILDING_COLUMNS)
    return spark.read.option("recursiveFileLookup", "true").parquet(dataset.base_path).select(*RAW_BUILDING_COLUMNS)


def enriched(df: DataFrame) -> DataFrame:
    """df with centroid_geom (a struct of lng and lat) and bbox_geom (the envelope, decoded only where it is used)."""
    s = wkb.shape_udf()(F.col("geometry"))
    return df.withColumn("centroid_geom", F.struct(F.col("centroid_lng").alias("lng"), F.col("centroid_lat").alias("lat"))).withColumn("_shape", s).withColumn("bbox_geom", F.struct(*[F.col("_shape")[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])).drop("_shape")


def jdbc_table(spark: SparkSession, url: str, table: str, *, key: str | None = None, parts: int | None = None, **options: str) -> DataFrame:
    """A table of an external database, with predicates and columns pushed to it.

    key: a numeric, date or timestamp column, by ranges of which `parts` connections read (as many as shuffle partitions, if not
    given); its bounds are asked of the database, rows without a key come with the first range. Without a key one connection reads.
    """
    read = lambda: spark.read.format("jdbc").option("url", url).options(**options)  # noqa: E731  a reader keeps what it is told
    if key is None:
        return read().option("dbtable", table).load()
    low, high = read().option("query", f"SELECT MIN({key}) AS low_key, MAX({key}) AS high_key FROM {table}").load().first()
    if low is None:
        return read().option("dbtable", table).load()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read().option("dbtable", table).option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", parts).load()


def build_views(spark: SparkSession) -> dict[str, str]:
    """Views of every registered dataset: name -> ok or the error, which does not stop the others. Repeating replaces."""
    out = {}
    jobs = [(view_name(k), lambda c=c: scan_features(spark, c)) for k, c in DATASETS.items()]
    jobs += [(view_name(k, "enriched"), lambda c=c: enriched(scan_features(spark, c))) for k, c in DATASETS.items()]
    jobs += [(view_name(k, "buildings_view"), lambda c=c: scan_buildings(spark, c, False)) for k, c in BUILDINGS.items()]
    for tier, wrap in (("buildings_partitioned", lambda x: x), ("buildings_enriched", enriched)):
        jobs += [(view_name(k, tier), lambda c=c, w=wrap: w(scan_buildings(spark, c, True))) for k, c in BUILDINGS.items() if c.h3_enriched]
    for name, make in jobs:
        try:
            make().createOrReplaceTempView(name)
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001  one dataset's absence must not hide the others
            out[name] = str(e).splitlines()[0]
    return out


def drop_views(spark: SparkSession) -> None:
    for name in list_views(spark):
        spark.catalog.dropTempView(name)


def list_views(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def tile_range(box: tuple[float, float, float, float], zoom: int | list[int] = 10, prefix: str = "") -> Column:
    """The tiles that a box can touch; of other zooms than those given all. Beyond the projection's edge rows are not pruned by y."""
    z, x, y = (F.col(prefix + c) for c in TILE)
    zooms = [zoom] if isinstance(zoom, int) else sorted(zoom)
    out = ~z.isin(zooms) if prefix else F.lit(False)
    for level in zooms:
        (x0, y1), (x1, y0) = geo.tile_of(box[0], box[1], level), geo.tile_of(box[2], box[3], level)
        found = x.between(x0, x1)
        if max(abs(box[1]), abs(box[3])) < geo.MERCATOR_LAT:
            found = found & y.between(y0, y1)
        out = out | ((z == level) & found if prefix or len(zooms) > 1 else found)
    return out


def cell_tiles(cell: str, zoom: int | list[int] = 10) -> Column | None:
    """The partitions that a cell can touch; None, which prunes nothing, near a pole or the antimeridian. Lakes of another zoom are not pruned."""
    box = h3.cell_box(cell) if h3.is_cell(cell) else None
    return None if box is None else tile_range(box, zoom, "p_")


def write_lake(features: DataFrame, path: str, max_records: int = 2_000_000, *, tiles: list[tuple[int, int, int]] | None = None, **facts) -> dict:
    """Write features as a new version of the lake: sorted, zstd, one directory per tile and run; the version that is then current.

    The shuffle is on the tile and a coarse slice of the z-order key: a dense tile spreads over several tasks and files,
    each a contiguous part of its sort order, instead of landing in one task. Tile columns are kept in the files too.
    tiles: only these are replaced, from features that lie in them; all others stay as the version before has them.
    Readers see the version before until the last step, which creates one small file (see snapshots). facts go into the version.
    """
    spark, path = features.sparkSession, path.rstrip("/")
    before, run = snapshots.current(spark, path), snapshots.new_run()
    tile = [F.col(c) for c in PARTITIONS]
    order = [F.asc_nulls_last("entropy_bucket"), F.asc_nulls_last("zorder_key"), F.desc_nulls_last("importance_byte"), F.asc("feature_id")]
    out = locked(features).withColumns({f"p_{c}": F.col(c) for c in TILE} | {RUN: F.lit(run)})
    if tiles is not None:
        out = out.filter(in_tiles(tiles))
    # the sort begins with the partition columns, or the writer would sort by them again and lose the order of rows
    (
        out.repartitionByRange(*tile, "entropy_bucket", "zorder_key")
        .sortWithinPartitions(*PARTITIONS, RUN, *order)
        .write.mode("append").partitionBy(*PARTITIONS, RUN)
        .option("compression", "zstd").option("parquet.compression.codec.zstd.level", "3").option("maxRecordsPerFile", max_records).parquet(path)
    )
    written = spark.read.schema(_STORED).parquet(path).filter(F.col(RUN) == run)
    table = tile_stats(written).withColumn(RUN, F.lit(run))
    if tiles is not None and before is not None:
        table = live_tiles(spark, path).filter(~in_tiles(tiles)).unionByName(table)
    table.write.parquet(f"{path}/_tiles/{run}")
    table = spark.read.parquet(f"{path}/_tiles/{run}")
    runs = sorted(r[RUN] for r in table.select(RUN).distinct().toLocalIterator())
    zooms = sorted(r.tile_z for r in table.select("tile_z").distinct().toLocalIterator())
    facts = {k: f(run) if callable(f) else f for k, f in facts.items()}
    return snapshots.publish(spark, path, before, {"run": run, "runs": runs, "zooms": zooms, "whole": tiles is None} | facts)


def in_tiles(tiles: list[tuple[int, int, int]]) -> Column:
    return F.struct(*TILE).isin([F.struct(*[F.lit(v).cast("int").alias(c) for c, v in zip(TILE, t, strict=True)]) for t in tiles]) if tiles else F.lit(False)


def read_tile(spark: SparkSession, path: str, z: int, x: int, y: int) -> DataFrame:
    """One tile; ValueError outside the grid. The partition filter reads that directory alone."""
    if not 0 <= z <= 20 or not 0 <= x < 1 << z or not 0 <= y < 1 << z:
        raise ValueError(f"tile {z}/{x}/{y} is outside the grid")
    return scan_lake(spark, path, (F.col("p_tile_z") == z) & (F.col("p_tile_x") == x) & (F.col("p_tile_y") == y))


def tile_stats(features: DataFrame) -> DataFrame:
    """Per tile: feature_count, size_bytes, entropy, run_id (of the first row in sort order), priority and url part."""
    first = F.struct(F.coalesce("entropy_bucket", F.lit(5)), F.col("zorder_key"), -F.coalesce(F.col("importance_byte").cast("int"), F.lit(0)), F.col("feature_id"))
    t = features.groupBy(*TILE).agg(
        F.count(F.lit(1)).alias("feature_count"), F.sum(F.coalesce("compressed_size_bytes", F.lit(0))).alias("size_bytes"),
        F.avg(F.coalesce(F.col("entropy_score").cast("double"), F.lit(0.0))).alias("entropy"), F.min_by("partition_run_id", first).alias("run_id"),
    )
    return t.withColumn("fetch_priority", scoring.fetch_priority(F.col("entropy"), F.col("size_bytes"))).withColumn("tile_path", F.format_string("z%d/%d/%d.parquet", *TILE))


_ENTRY = "z int, x int, y int, featureCount long, entropyScore double, compressedSizeBytes long, partitionRunId string, fetchPriority string, parquetUrl string"


def manifest_document(stats: DataFrame, country: str, zoom: int, resolutions: tuple[int, ...], subdir: str = "", now: datetime | None = None) -> DataFrame:
    """One row with the manifest as JSON text, made by Spark: it is one document with an entry for each tile."""
    now = now or datetime.now(timezone.utc)
    url = F.concat(F.lit(f"{country.lower()}/{subdir}"), F.col("tile_path"))
    values = ("tile_z", "tile_x", "tile_y", "feature_count", F.round("entropy", 4), "size_bytes", F.coalesce("run_id", F.lit("")), "fetch_priority", url)
    entry = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n.split()[0]) for v, n in zip(values, _ENTRY.split(", "), strict=True)])
    all_ = stats.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("feature_count"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(entry)).alias("tiles"))
    head = {"countryCode": country, "tileZoom": zoom, "h3Resolutions": list(resolutions), "cellProvider": "h3", "generatedAt": now.replace(tzinfo=None).isoformat() + "Z"}
    fields = [F.lit(json.dumps(head)[:-1] + ', "tile_count": '), F.col("n").cast("string"), F.lit(', "total_features": '), F.col("total").cast("string"), F.lit(', "tileKeys": '), F.to_json("tiles"), F.lit(f', "budgetHint": {json.dumps(BUDGET)}}}')]
    return all_.select(F.concat(*fields).alias("value"))


def write_manifest(stats: DataFrame, country: str, path: str, zoom: int, resolutions: tuple[int, ...], subdir: str = "", now: datetime | None = None) -> dict:
    """The manifest as a text file below path, through the same file system as the tiles; and the document."""
    target = f"{path.rstrip('/')}/_manifest"
    manifest_document(stats, country, zoom, resolutions, subdir, now).write.mode("overwrite").option("lineSep", "\n").text(target)
    return json.loads(stats.sparkSession.read.text(target, wholetext=True).first().value)


def manifest_text(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's text, of the current version where the path has versions."""
    version = snapshots.current(spark, path)
    where = f"_manifests/{version['run']}" if version and version.get("manifest") else "_manifest"
    return spark.read.text(f"{path.rstrip('/')}/{where}", wholetext=True)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(manifest_text(spark, path).first().value)


def manifest_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's entries as rows."""
    parsed = F.from_json("value", f"tileKeys array<struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>>")
    return manifest_text(spark, path).select(F.explode(parsed["tileKeys"]).alias("t")).select("t.*")


def lake_path(dataset: Dataset | BuildingDataset, root: str | None = None) -> str:
    if isinstance(dataset, BuildingDataset):
        return dataset.enriched_path(root)
    return f"{(root or lake_root()).rstrip('/')}/{dataset.country.lower()}/features"
