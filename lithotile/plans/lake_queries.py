"""Registered queries of the spatial lake on the driver's tables, each with the SQL that DuckDB runs beside it.

orders stand for map features, part for raw buildings: both are projected with integer arithmetic that is the same on both
engines. Every query reads its whole table; limits are those of the viewport service.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, h3, scoring, wkb, zoom as Z
from ..operators import exporters
from ..operators import metrics as M
from ..operators import viewport as V
from ..session import ship
from ..sources import lake
from ..sources import registry as R
from . import h3_sql

BOX = (36.70, -1.40, 36.90, -1.20)
MINUTE = "20250101T0000"
#: The cell of resolution 7 at 1.2921 S, 36.8219 E, and a polygon with a hole.
_CELL7 = "877a6e42cffffff"
POLYGON = [[(36.70, -1.40), (36.90, -1.38), (36.85, -1.20), (36.72, -1.25)], [(36.78, -1.33), (36.82, -1.33), (36.80, -1.28)]]
KENYA = R.BUILDINGS.get("kenya-buildings")
KENYA_ENRICHED = R.BuildingDataset("KE", "", "kenya", ("1223", "1232", "1233"), h3_enriched=True)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lng(key: str):  # noqa: ANN202
    return ((F.col(key) * 7919) % 30011) / 1e5 + 36.65


def _lat(key: str):  # noqa: ANN202
    return ((F.col(key) * 104729) % 30011) / 1e5 - 1.45


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """orders as source rows: feature_id, tags, country, lng, lat."""
    o = _read(spark, d, "orders")
    p, k = F.substring("o_orderpriority", 1, 1), F.col("o_custkey")
    building = F.element_at(F.array(*map(F.lit, ("residential", "commercial", "Mall", ""))), (k % 4 + 1).cast("int"))
    amenity = F.element_at(F.array(*map(F.lit, ("hospital", "university", "cafe"))), (k % 3 + 1).cast("int"))
    highway = F.element_at(F.array(*map(F.lit, ("motorway", "trunk", "primary", "secondary", "tertiary", "track"))), (k % 6 + 1).cast("int"))
    none = F.lit(None).cast("string")
    tags = F.map_filter(
        F.map_from_arrays(F.array(*map(F.lit, ("highway", "building", "amenity", "landuse", "population"))), F.array(F.when(p == "1", highway).otherwise(none), F.when(p == "2", building).otherwise(none), F.when(p == "3", amenity).otherwise(none), F.when(p == "4", F.lit("forest")).otherwise(none), F.when(k % 7 == 0, (k * 3).cast("string")).otherwise(none))),
        lambda _, v: v.isNotNull(),
    )
    area = F.when(p.isin("2", "3"), (k % 97) * 1000 + 50.0)
    return o.select(F.concat(F.lit("node/"), F.col("o_orderkey").cast("string")).alias("feature_id"), tags.alias("tags"), area.alias("area_m2"), F.when(p == "5", "CIV").alias("occupancy"), F.when(k % 2 == 0, "kenya").otherwise("canary-islands").alias("country"), _lng("o_orderkey").alias("lng"), _lat("o_orderkey").alias("lat"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """orders as staged features with cells and tiles."""
    t = F.col("tags")
    x = tagged(spark, d).select(
        "feature_id", scoring.feature_type(t).alias("feature_type"), F.col("lat").alias("centroid_lat"), F.col("lng").alias("centroid_lng"), F.col("country").alias("country_code"),
        *[t[c].alias(c) for c in ("highway", "building", "amenity", "landuse")], scoring.try_int(t["population"]).alias("population"), scoring.road_class(t["highway"]).alias("road_class"),
        "occupancy", "area_m2",
    )
    return M.with_cells(x)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return M.enrich(features(spark, d), MINUTE)


def buildings(spark: SparkSession, d: str) -> DataFrame:
    """part as raw building rows."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    height = F.when(k % 5 == 0, F.concat(F.lit("H:"), s)).when(k % 5 == 1, F.concat(F.lit("HBET:"), s, F.lit("-"), (F.col("p_size") + 2).cast("string"))).when(k % 5 == 2, F.concat(F.lit("HHT:"), s, F.lit(".5"))).when(k % 5 == 3, s)
    kind = F.create_map(*[F.lit(x) for x in ("ECONOMY", "RES", "STANDARD", "RES", "LARGE", "COM", "MEDIUM", "IND", "PROMO", "CIV", "SMALL", "UNK")])
    half = F.col("p_size") * 1e-5
    lng, lat = _lng("p_partkey"), _lat("p_partkey")
    return _read(spark, d, "part").select(
        k.alias("id"), F.lit(None).cast("string").alias("floorspace"), kind[F.col("p_type")].alias("occupancy"), F.lit(None).cast("string").alias("relation_id"),
        F.concat(F.element_at(F.array(*map(F.lit, ("1223", "1232", "1233", "1202"))), (k % 4 + 1).cast("int")), k.cast("string")).alias("quadkey"), height.alias("height"),
        F.struct((lng - half).alias("xmin"), (lat - half).alias("ymin"), (lng + half).alias("xmax"), (lat + half).alias("ymax")).alias("bbox"),
    )


def cell_buildings(spark: SparkSession, d: str) -> DataFrame:
    """part as enriched building rows: centroids, cells, area from the box."""
    x = buildings(spark, d)
    lng, lat = V.bbox_center()
    x = x.select(F.concat(F.lit("building/"), F.col("id").cast("string")).alias("feature_id"), "occupancy", scoring.height_m(F.col("height")).alias("height_m"), lng.alias("centroid_lng"), lat.alias("centroid_lat"), V.bbox_area_m2().alias("area_m2"))
    return M.with_cells(x)


def drawn(spark: SparkSession, d: str) -> DataFrame:
    """part as raw building rows with their outline as WKB."""
    b = F.col("bbox")
    return buildings(spark, d).withColumns({"geometry": wkb.box_to_wkb(b["xmin"], b["ymin"], b["xmax"], b["ymax"]), "source": F.lit("OSM")})


def staged_buildings(spark: SparkSession, d: str) -> DataFrame:
    return M.stage_buildings(drawn(spark, d), KENYA)


def staged_features(spark: SparkSession, d: str) -> DataFrame:
    """orders as map features with point geometry, through the dataset's country and box filters."""
    x = tagged(spark, d).withColumn("geom", wkb.box_to_wkb(F.col("lng"), F.col("lat"), F.col("lng"), F.col("lat")))
    return M.stage_features(x, R.Dataset("KE", "", country_filter="kenya", bbox=BOX))


def _r(*cols: str):  # noqa: ANN202
    return [F.round(c, 6).alias(c) for c in cols]


def _bbox(zoom: int):  # noqa: ANN202
    return lambda s, d: V.query_bbox(scored(s, d), BOX, zoom).select("feature_id", "entropy_bucket", F.col("importance_byte").cast("int").alias("importance_byte"))


def _towns_boxes(s: SparkSession) -> DataFrame:
    t = R.towns_df(s)
    return t.select("key", (F.col("lng") - F.col("lng_extent")).alias("sw_lng"), (F.col("lat") - F.col("lat_extent")).alias("sw_lat"), (F.col("lng") + F.col("lng_extent")).alias("ne_lng"), (F.col("lat") + F.col("lat_extent")).alias("ne_lat"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    return lake.tile_stats(M.with_cells(scored(s, d), zoom=12).withColumn("compressed_size_bytes", F.length("feature_id").cast("long") * 100).withColumn("zorder_key", F.lit(0)))


def _roundtrip(s: SparkSession, d: str) -> DataFrame:
    from ..sources.shared import folder

    path = f"{folder(s)}/lake"
    x = scored(s, d).withColumn("zorder_key", scoring.zorder_key(geo.cell_to_long(F.col("h3_8")), F.col("feature_id"))).withColumn("compressed_size_bytes", F.lit(0).cast("long"))
    lake.write_lake(x, path)
    back = lake.scan_lake(s, path)
    return back.groupBy(*lake.TILE).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("importance_byte").cast("long")).alias("importance"))


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """The manifest of the tiles, written and read again."""
    from ..sources.shared import folder

    path = f"{folder(s)}/manifest"
    lake.write_manifest(_stats(s, d), "KE", path, 12, M.RESOLUTIONS)
    return lake.manifest_tiles(s, path).select(F.col("z").alias("tile_z"), F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), F.col("featureCount").alias("feature_count"), F.col("compressedSizeBytes").alias("size_bytes"), F.col("fetchPriority").alias("fetch_priority"), F.col("parquetUrl").alias("url"))


def _exported(s: SparkSession, d: str) -> DataFrame:
    """Flat rows of nested cell records, written with validation and read again."""
    from ..sources.shared import folder

    path = f"{folder(s)}/cells"
    nested = _read(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("cellId"), F.lit(9).alias("resolution"), F.struct(_lat("p_partkey").alias("lat"), _lng("p_partkey").alias("lng")).alias("center"),
        F.when(F.col("p_partkey") % 3 != 0, F.create_map(F.lit("size"), F.col("p_size"))).alias("properties"),
    )
    exporters.export(exporters.flat_cells(nested), path)
    return s.read.parquet(path).select("cellId", "resolution", *_r("lat", "lng"), "properties")


def _shapes(s: SparkSession, d: str) -> DataFrame:
    x = drawn(s, d).withColumn("s", wkb.shape_udf(32637)(F.col("geometry")))
    return x.select("id", *[F.round(F.col("s")[c], 6).alias(c) for c in ("lng", "lat", "xmin", "ymin", "xmax", "ymax")], F.round("s.area_m2", 1).alias("area_m2"), F.round("s.perimeter_m", 2).alias("perimeter_m"))


def _encode_features(s: SparkSession, d: str) -> DataFrame:
    get = lambda p: F.get_json_object("properties", p)
    x = V.encode_features(lake.locked(scored(s, d)))
    return x.select("type", get("$.feature_id").alias("feature_id"), get("$.importance_byte").cast("int").alias("importance_byte"), F.round(F.get_json_object("geometry", "$.coordinates[0]").cast("double"), 6).alias("lng"), F.round(F.get_json_object("geometry", "$.coordinates[1]").cast("double"), 6).alias("lat"))


def _encode_buildings(s: SparkSession, d: str) -> DataFrame:
    get, at = lambda p: F.get_json_object("properties", p), lambda p: F.get_json_object("geometry", p)
    x = V.encode_buildings(staged_buildings(s, d))
    return x.select(get("$.id").alias("id"), at("$.type").alias("geometry_type"), F.round(at("$.coordinates[0][2][0]").cast("double"), 6).alias("lng"), F.round(at("$.coordinates[0][2][1]").cast("double"), 6).alias("lat"), F.round(get("$.height_m").cast("double"), 6).alias("height_m"), get("$.source").alias("source"))


def _nearest(s: SparkSession, d: str) -> DataFrame:
    km = geo.haversine_m(F.col("centroid_lat"), F.col("centroid_lng"), F.lit(-1.2921), F.lit(36.8219))
    return V.top(features(s, d).select("feature_id", F.round(km, 3).alias("meters")), 20, F.asc("meters"), F.asc("feature_id"))


def _geodesics(s: SparkSession, d: str) -> DataFrame:
    """Each feature's distance from Nairobi on the ellipsoid, and how a step of longitude grows from Mombasa's latitude to its own."""
    lat, lng = F.col("centroid_lat"), F.col("centroid_lng")
    return features(s, d).select("feature_id", F.round(geo.geodesic(lat, lng, F.lit(-1.2921), F.lit(36.8219)), 2).alias("meters"), F.round(geo.growth(lat, F.lit(-4.0435)), 6).alias("growth"))


def _zooms(s: SparkSession, d: str) -> DataFrame:
    """What each feature is shown by, at a zoom of its own."""
    rows = [tuple(Z.describe(z, -1.2921).values())[:1] + (Z.semantic_level(z), Z.resolution_for_zoom(z), Z.feature_limit(z), Z.importance_threshold(z)) for z in range(21)]
    zooms = s.createDataFrame(rows, "zoom int, semantic_level string, h3_resolution int, feature_limit int, importance_threshold int")
    return _read(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 21).cast("int").alias("zoom")).join(F.broadcast(zooms), "zoom")


def _towns(s: SparkSession, d: str) -> DataFrame:
    """The boxes of all towns with the features in them."""
    counts = V.in_viewports(features(s, d), _towns_boxes(s)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return _towns_boxes(s).join(counts, "key", "left").select("key", *_r("sw_lng", "sw_lat", "ne_lng", "ne_lat"), F.coalesce("n", F.lit(0)).alias("n"))


def _town_buildings(s: SparkSession, d: str) -> DataFrame:
    """Towns with the building dataset of theirs and the raw buildings that it has."""
    raw = buildings(s, d)
    counts = [raw.filter(b.quadkey_filter()).agg(F.count(F.lit(1)).alias("n")).withColumn("building_key", F.lit(k)) for k, b in R.BUILDINGS.items()]
    linked = R.towns_df(s).join(F.broadcast(R.building_datasets_df(s)), F.col("dataset_key") == F.col("osm_dataset_key"), "left")
    return linked.join(counts[0].unionByName(counts[1]), "building_key", "left").select("key", "building_key", "zoom_gate", "n")


def _previous(f: DataFrame) -> DataFrame:
    """An earlier state of all features, in which types of one first letter were one type."""
    return M.cell_metrics(f.withColumn("feature_type", F.substring("feature_type", 1, 1))).select("h3_8", F.col("entropy_score").alias("old_entropy"), F.col("entropy_bucket").alias("old_bucket"))


def _hysteresis(s: SparkSession, d: str) -> DataFrame:
    f = features(s, d)
    x = M.cell_metrics(f).join(_previous(f), "h3_8", "left")
    return x.select("h3_8", scoring.hysteresis(F.col("entropy_score"), F.col("old_entropy"), F.col("entropy_bucket"), F.col("old_bucket")).alias("bucket"))


def _encode(s: SparkSession, d: str) -> DataFrame:
    x = V.encode_raw_buildings(buildings(s, d).withColumns({"last_update": F.lit(None).cast("timestamp"), "source": F.lit("OSM")}))
    return x.select("type", F.get_json_object("geometry", "$.type").alias("geometry_type"), F.get_json_object("properties", "$.id").cast("long").alias("id"), F.get_json_object("properties", "$.height_m").cast("double").alias("height_m"), F.round(F.get_json_object("properties", "$.bbox_area_m2").cast("double"), 1).alias("bbox_area_m2"))


_RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "feature_type_case": lambda s, d: features(s, d).select("feature_id", "feature_type"),
    "road_class_case": lambda s, d: features(s, d).select("feature_id", F.col("road_class").cast("int").alias("road_class")),
    "tag_map_extract": lambda s, d: features(s, d).select("feature_id", "highway", "building", "amenity", "landuse", "population"),
    "quadtree_tile": lambda s, d: features(s, d).select("feature_id", "tile_z", "tile_x", "tile_y"),
    "cell_ids": lambda s, d: features(s, d).select("feature_id", "h3_7", "h3_8", "h3_9", "h3_10"),
    "source_filter": lambda s, d: tagged(s, d).withColumn("geometry", F.lit("x")).filter(R.DATASETS.get("kenya").source_filter()).select("feature_id", "country"),
    "quadkey_prefix_filter": lambda s, d: buildings(s, d).filter(KENYA.quadkey_filter()).select("id", "quadkey"),
    "quadkey_caller_prefix": lambda s, d: buildings(s, d).filter(KENYA.quadkey_filter("12021")).select("id", "quadkey"),
    "building_identity": lambda s, d: cell_buildings(s, d).select("feature_id", "occupancy", F.lit("building").alias("feature_type")),
    "type_distribution": lambda s, d: M.type_distribution(features(s, d)),
    "cell_entropy": lambda s, d: M.cell_metrics(features(s, d)).select("h3_8", *_r("entropy_score")),
    "cell_variance_bucket": lambda s, d: M.cell_metrics(features(s, d)).select("h3_8", *_r("cell_variance"), "entropy_bucket"),
    "cell_density": lambda s, d: M.cell_density(features(s, d)),
    "importance_bytes": lambda s, d: M.with_importance(features(s, d)).select("feature_id", "neighbours", F.col("importance_byte").cast("int").alias("importance_byte")),
    "cell_metrics_join": lambda s, d: scored(s, d).select("feature_id", "entropy_bucket", *_r("entropy_score", "cell_variance")),
    "adaptive_resolution": lambda s, d: M.cell_metrics(features(s, d), "h3_7").select("h3_7", scoring.adaptive_resolution(F.col("entropy_score"), F.col("cell_variance")).alias("resolution")),
    "hysteresis": _hysteresis,
    "partition_run_id": lambda s, d: scored(s, d).select("feature_id", "partition_run_id"),
    "zorder_key": lambda s, d: features(s, d).select("feature_id", scoring.zorder_key(geo.cell_to_long(F.col("h3_8")), F.col("feature_id")).alias("zorder_key")),
    "bbox_zoom9": _bbox(9),
    "bbox_zoom12": _bbox(12),
    "bbox_zoom15": _bbox(15),
    "h3_cell_query": lambda s, d: V.query_h3(scored(s, d), _CELL7, 7).select("feature_id", F.col("importance_byte").cast("int").alias("importance_byte")),
    "features_in_polygon": lambda s, d: V.in_cells(features(s, d), POLYGON, 9).select("feature_id", "h3_9"),
    "buildings_bbox": lambda s, d: V.query_buildings(buildings(s, d), KENYA, BOX, 15).select("id", "occupancy", V.bbox_area_m2().alias("bbox_area_m2")),
    "buildings_occupancy": lambda s, d: V.query_buildings(buildings(s, d), KENYA, BOX, 15, occupancy="RES").select("id", "occupancy"),
    "buildings_cells": lambda s, d: V.query_buildings(cell_buildings(s, d), KENYA_ENRICHED, (36.80, -1.30, 36.83, -1.27), 15).select("feature_id", "area_m2"),
    "building_stats": lambda s, d: V.building_stats(buildings(s, d), KENYA, BOX, 15),
    "building_stats_cells": lambda s, d: V.building_stats(cell_buildings(s, d), KENYA_ENRICHED, (36.80, -1.30, 36.83, -1.27), 15),
    "height_parse": lambda s, d: buildings(s, d).select("id", scoring.height_m(F.col("height")).alias("height_m"), F.round(scoring.height_floors(F.col("height")), 6).alias("height_floors")),
    "height_parse_raw_path": lambda s, d: buildings(s, d).select("id", scoring.height_m_raw_path(F.col("height")).alias("height_m")),
    "geojson_buildings": _encode,
    "tile_manifest": lambda s, d: _stats(s, d).select("tile_z", "tile_x", "tile_y", "feature_count", "size_bytes", F.round("entropy", 4).alias("entropy"), "fetch_priority", "tile_path"),
    "manifest_totals": lambda s, d: _stats(s, d).agg(F.count(F.lit(1)).alias("tile_count"), F.sum("feature_count").alias("total_features")),
    "distinct_tiles": lambda s, d: features(s, d).select(*lake.TILE).distinct(),
    "adaptive_tiles": lambda s, d: M.adaptive_tiles(features(s, d), 500, 6, 16),
    "top10_tiles": lambda s, d: _stats(s, d).orderBy(F.desc("feature_count"), *lake.TILE).limit(10).select("tile_x", "tile_y", "feature_count"),
    "towns_bbox": _towns,
    "towns_buildings_link": _town_buildings,
    "town_viewport_counts": lambda s, d: V.in_viewports(features(s, d), _towns_boxes(s)).groupBy("key").agg(F.count(F.lit(1)).alias("n")),
    "zoom_describe": _zooms,
    "haversine_nearest": _nearest,
    "geodesics": _geodesics,
    "bbox_area": lambda s, d: buildings(s, d).select("id", F.round(geo.bbox_area_km2(*[F.col("bbox")[c] for c in ("xmin", "ymin", "xmax", "ymax")]), 9).alias("area_km2")),
    "features_and_buildings": lambda s, d: lake.locked(features(s, d)).unionByName(lake.locked(cell_buildings(s, d).withColumn("feature_type", F.lit("building")))).groupBy("feature_type").agg(F.count(F.lit(1)).alias("n")),
    "lake_roundtrip": _roundtrip,
    "manifest_entries": _manifest,
    "flat_cells_export": _exported,
    "wkb_shapes": _shapes,
    "wkb_in_box": lambda s, d: drawn(s, d).filter(wkb.meets_box_udf(BOX)(F.col("geometry"))).select("id"),
    "stage_features": lambda s, d: staged_features(s, d).select("feature_id", "feature_type", "country_code", *_r("centroid_lng", "centroid_lat"), *lake.TILE, "compressed_size_bytes"),
    "stage_buildings": lambda s, d: staged_buildings(s, d).select("feature_id", "source_provider", *_r("height_m", "height_floors"), F.round("area_m2", 1).alias("area_m2"), F.round("perimeter_m", 2).alias("perimeter_m"), *lake.TILE, "compressed_size_bytes"),
    "geojson_features": _encode_features,
    "geojson_enriched": _encode_buildings,
}
QUERIES = {k: (lambda s, d, f=f: f(ship(s), d)) for k, f in _RUN.items()}

_FEATURES = """
    tagged AS (SELECT 'node/' || o_orderkey AS feature_id, o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'kenya' ELSE 'canary-islands' END AS country,
        ((o_orderkey * 7919) % 30011) / 1e5 + 36.65e0 AS lng, ((o_orderkey * 104729) % 30011) / 1e5 - 1.45e0 AS lat,
        CASE WHEN o_orderpriority[1] = '1' THEN (['motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'track'])[o_custkey % 6 + 1] END AS highway,
        CASE WHEN o_orderpriority[1] = '2' THEN (['residential', 'commercial', 'Mall', ''])[o_custkey % 4 + 1] END AS building,
        CASE WHEN o_orderpriority[1] = '3' THEN (['hospital', 'university', 'cafe'])[o_custkey % 3 + 1] END AS amenity,
        CASE WHEN o_orderpriority[1] = '4' THEN 'forest' END AS landuse, CASE WHEN o_custkey % 7 = 0 THEN CAST(o_custkey * 3 AS INTEGER) END AS population,
        CASE WHEN o_orderpriority[1] IN ('2', '3') THEN o_custkey % 97 * 1000 + 50e0 ELSE 500e0 END AS area, CASE WHEN o_orderpriority[1] = '5' THEN 'CIV' END AS occupancy FROM orders),
    {cells},
    features AS (SELECT tagged.*, h3_7, h3_8, h3_9, h3_10, lat_9 AS mid_lat, lng_9 AS mid_lng, CASE WHEN highway IS NOT NULL THEN 'road' WHEN building IS NOT NULL THEN 'building' WHEN amenity IS NOT NULL THEN 'amenity' WHEN landuse IS NOT NULL THEN 'landuse' ELSE 'unknown' END AS feature_type,
        CASE highway WHEN 'motorway' THEN 1 WHEN 'trunk' THEN 2 WHEN 'primary' THEN 3 WHEN 'secondary' THEN 4 WHEN 'tertiary' THEN 5 ELSE 6 END AS road_class, {tiles} FROM tagged JOIN cells USING (o_orderkey)),
    types AS (SELECT h3_8, feature_type, count(*) AS n FROM features GROUP BY 1, 2),
    shares AS (SELECT h3_8, n, n * 1e0 / sum(n) OVER (PARTITION BY h3_8) AS p FROM types),
    metrics AS (SELECT h3_8, sum(-p * log2(p)) AS raw, round(0e0 - sum(p * log2(p)) + 0e0, 6) AS entropy_score, {variance} AS cell_variance FROM shares GROUP BY 1),
    bucketed AS (SELECT h3_8, CASE WHEN abs(raw) < 1e-9 THEN 0e0 ELSE entropy_score END AS entropy_score, cell_variance, CAST(least(floor(least(raw / log2(10), 1e0) * 10), 9) AS INTEGER) AS entropy_bucket FROM metrics),
    density AS (SELECT h3_9, count(*) AS n FROM features GROUP BY 1),
    weighted AS (SELECT f.*, greatest(0, d.n - 1) AS neighbours, lower(coalesce(nullif(building, ''), nullif(amenity, ''), occupancy, '')) AS tag FROM features f JOIN density d USING (h3_9)),
    scored AS (SELECT *, CAST(round_even((0.4e0 * least(1e0, log10(area / 500e0 + 1e0) / 2) + 0.5e0 * CASE tag WHEN 'hospital' THEN 0.9e0 WHEN 'university' THEN 0.9e0 WHEN 'mall' THEN 0.6e0 WHEN 'commercial' THEN 0.6e0 WHEN 'civ' THEN 0.7e0 WHEN 'residential' THEN 0.3e0 ELSE 0.1e0 END
        + 0.1e0 / (1 + neighbours) + 0.2e0 * exp(-10e0)) * 127, 0) AS INTEGER) AS importance_byte FROM weighted JOIN bucketed USING (h3_8))
"""


#: The population variance of shares n / N over k types, (k * sum n^2 - N^2) / (k * N)^2, in whole numbers, halves up at 6 digits.
_VARIANCE = "((2000000::HUGEINT * (count(*)::HUGEINT * sum(n * n)::HUGEINT - sum(n)::HUGEINT * sum(n)::HUGEINT) + count(*)::HUGEINT * count(*)::HUGEINT * sum(n)::HUGEINT * sum(n)::HUGEINT) // (2::HUGEINT * count(*)::HUGEINT * count(*)::HUGEINT * sum(n)::HUGEINT * sum(n)::HUGEINT))::DOUBLE / 1e6"


def _tiles_sql() -> str:
    x = lambda z: f"CAST(floor((lng + 180e0) / 360e0 * {1 << z}) AS INTEGER)"
    y = lambda z: f"CAST(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * {1 << z}) AS INTEGER)"
    return f"10 AS tile_z, {x(10)} AS tile_x, {y(10)} AS tile_y, {x(12)} AS tile12_x, {y(12)} AS tile12_y"


_F = "WITH RECURSIVE" + _FEATURES.replace("{cells}", h3_sql.cells("cells", "tagged", "o_orderkey", M.RESOLUTIONS).lstrip()).replace("{tiles}", _tiles_sql()).replace("{variance}", _VARIANCE)
_B = """WITH buildings AS (SELECT p_partkey AS id, p_size, CASE p_type WHEN 'ECONOMY' THEN 'RES' WHEN 'STANDARD' THEN 'RES' WHEN 'LARGE' THEN 'COM' WHEN 'MEDIUM' THEN 'IND' WHEN 'PROMO' THEN 'CIV' WHEN 'SMALL' THEN 'UNK' END AS occupancy,
        (['1223', '1232', '1233', '1202'])[p_partkey % 4 + 1] || p_partkey AS quadkey,
        CASE p_partkey % 5 WHEN 0 THEN 'H:' || p_size WHEN 1 THEN 'HBET:' || p_size || '-' || (p_size + 2) WHEN 2 THEN 'HHT:' || p_size || '.5' WHEN 3 THEN CAST(p_size AS VARCHAR) END AS height,
        ((p_partkey * 7919) % 30011) / 1e5 + 36.65e0 - p_size * 1e-5 AS xmin, ((p_partkey * 7919) % 30011) / 1e5 + 36.65e0 + p_size * 1e-5 AS xmax,
        ((p_partkey * 104729) % 30011) / 1e5 - 1.45e0 - p_size * 1e-5 AS ymin, ((p_partkey * 104729) % 30011) / 1e5 - 1.45e0 + p_size * 1e-5 AS ymax FROM part),
    shaped AS (SELECT *, (xmin + xmax) / 2 AS lng, (ymin + ymax) / 2 AS lat, round(abs(xmax - xmin) * 111320e0 * cos(radians((ymin + ymax) / 2)) * abs(ymax - ymin) * 110574e0, 1) AS area,
        CASE WHEN height LIKE 'H:%' THEN CAST(substr(height, 3) AS DOUBLE) * 3.5e0 WHEN height LIKE 'HBET:%' THEN (p_size + 1) * 3.5e0 WHEN height LIKE 'HHT:%' THEN CAST(substr(height, 5) AS DOUBLE) ELSE CAST(height AS DOUBLE) END AS height_m,
        CASE WHEN height LIKE 'H:%' THEN p_size * 1e0 WHEN height LIKE 'HBET:%' THEN p_size + 1e0 WHEN height LIKE 'HHT:%' THEN (p_size + 0.5e0) / 3.5e0 ELSE CAST(height AS DOUBLE) / 3.5e0 END AS height_floors FROM buildings)"""
_IN = "xmin <= 36.90e0 AND xmax >= 36.70e0 AND ymin <= -1.20e0 AND ymax >= -1.40e0 AND (quadkey LIKE '1223%' OR quadkey LIKE '1232%' OR quadkey LIKE '1233%')"
#: Buildings with their cell of resolution 9 and that cell's centre; those of the viewport lie in cells whose centre lies in it.
_B9 = _B.replace("WITH buildings", "WITH RECURSIVE buildings") + "," + h3_sql.cells("cells", "shaped", "id", (9,)) + ", celled AS (SELECT * FROM shaped JOIN cells USING (id))"
_IN9 = "lng_9 BETWEEN 36.80e0 AND 36.83e0 AND lat_9 BETWEEN -1.30e0 AND -1.27e0"
_COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE occupancy = '{o}') AS {o.lower()}" for o in ("RES", "COM", "IND", "CIV", "UNK")) + ", count({h}) AS with_height"
_STATS = """, tiles AS (SELECT 12 AS tile_z, tile12_x AS tile_x, tile12_y AS tile_y, count(*) AS feature_count, CAST(sum(length(feature_id) * 100) AS BIGINT) AS size_bytes, avg(entropy_score) AS entropy FROM scored GROUP BY 1, 2, 3)"""
_T = "WITH towns(key, lat, lng, lat_extent, lng_extent, dataset_key) AS (VALUES " + ", ".join(f"('{k}', {t.lat!r}e0, {t.lng!r}e0, {t.lat_extent!r}e0, {t.lng_extent!r}e0, {'NULL' if t.dataset_key is None else repr(t.dataset_key)})" for k, t in R.TOWNS.items()) + ")"
_BOXES = "boxes AS (SELECT key, lng - lng_extent AS sw_lng, lat - lat_extent AS sw_lat, lng + lng_extent AS ne_lng, lat + lat_extent AS ne_lat FROM towns)"


#: Outlines in UTM zone 37 by the series of Snyder (1987), which is not the one that the code uses; area by the shoelace sum.
_UTM = _B + """, corners AS (SELECT id, k, radians(CASE WHEN k IN (0, 3) THEN xmin ELSE xmax END - 39e0) AS lam, radians(CASE WHEN k < 2 THEN ymin ELSE ymax END) AS phi FROM shaped, range(4) t(k)),
    ellipsoid AS (SELECT 6378137e0 AS a, 0.0066943799901413165e0 AS e2, 0.0067394967422764341e0 AS q),
    terms AS (SELECT *, a / sqrt(1 - e2 * sin(phi) ** 2) AS n, tan(phi) ** 2 AS t, q * cos(phi) ** 2 AS c, lam * cos(phi) AS l,
        a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - 35 * e2 ** 3 / 3072 * sin(6 * phi)) AS m FROM corners, ellipsoid),
    plane AS (SELECT id, k, 0.9996e0 * n * (l + (1 - t + c) * l ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * q) * l ** 5 / 120) AS x,
        0.9996e0 * (m + n * tan(phi) * (l ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * l ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * q) * l ** 6 / 720)) AS y FROM terms),
    sides AS (SELECT p.id, p.x - o.x AS x, p.y - o.y AS y, r.x - o.x AS x2, r.y - o.y AS y2 FROM plane p JOIN plane r ON r.id = p.id AND r.k = (p.k + 1) % 4 JOIN plane o ON o.id = p.id AND o.k = 0),
    outlines AS (SELECT id, abs(sum(x * y2 - x2 * y)) / 2 AS utm_area, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS perimeter FROM sides GROUP BY id)"""
_KE = "(quadkey LIKE '1223%' OR quadkey LIKE '1232%' OR quadkey LIKE '1233%')"


def _tile10(lng: str, lat: str) -> str:
    return f"10 AS tile_z, CAST(floor(({lng} + 180e0) / 360e0 * 1024) AS INTEGER) AS tile_x, CAST(floor((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2e0 * 1024) AS INTEGER) AS tile_y"


def _vincenty_sql(name: str, rows: str) -> str:
    """CTEs that end in {name}: id and meters, for rows (id, lat1, lng1, lat2, lng2), by eight rounds of Vincenty's inverse formula."""
    f = "(1e0 / 298.257223563e0)"
    return f"""{name}_u AS (SELECT id, atan((1 - {f}) * tan(radians(lat1))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2, radians(lng2 - lng1) AS l FROM ({rows})),
    {name}_l AS (SELECT id, u1, u2, l, l AS lam, 0 AS k FROM {name}_u UNION ALL SELECT id, u1, u2, l, l + (1 - g) * {f} * sa * (sigma + g * s * (mid + g * c * (2 * mid * mid - 1))), k + 1 FROM (
        SELECT *, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS g, c - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS mid FROM (
        SELECT *, atan2(s, c) AS sigma, CASE WHEN s = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / s END AS sa FROM (
        SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS c FROM {name}_l WHERE k < 8)))),
    {name} AS (SELECT id, 6356752.314245179e0 * (1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))) * (sigma - m * s * (mid + m / 4 * (c * (2 * mid * mid - 1) - m / 6 * mid * (4 * s * s - 3) * (4 * mid * mid - 3)))) AS meters FROM (
        SELECT *, v / 1024 * (256 + v * (-128 + v * (74 - 47 * v))) AS m FROM (
        SELECT *, (1 - sa * sa) * 0.00673949674227643e0 AS v, c - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS mid FROM (
        SELECT *, atan2(s, c) AS sigma, CASE WHEN s = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / s END AS sa FROM (
        SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS c FROM {name}_l WHERE k = 8)))))"""


def _inside(lng: str, lat: str) -> str:
    """Sides of POLYGON that a ray to the east of each feature's point crosses."""
    sides = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for r in POLYGON for a, b in zip(r, [*r[1:], r[0]], strict=True))
    return f""", sides(x1, y1, x2, y2) AS (VALUES {sides}), crossed AS (SELECT o_orderkey, count(*) FILTER (WHERE (y1 > {lat}) <> (y2 > {lat}) AND {lng} < x1 + ({lat} - y1) / (y2 - y1) * (x2 - x1)) AS n FROM features, sides GROUP BY 1)"""


def _bbox_sql(least: int, limit: int) -> str:
    return f"{_F} SELECT feature_id, entropy_bucket, importance_byte FROM scored WHERE lng BETWEEN 36.70e0 AND 36.90e0 AND lat BETWEEN -1.40e0 AND -1.20e0 AND importance_byte >= {least} ORDER BY entropy_bucket, importance_byte DESC, feature_id LIMIT {limit}"


_OLD = _F + """, types2 AS (SELECT h3_8, substr(feature_type, 1, 1) AS feature_type, count(*) AS n FROM features GROUP BY 1, 2), shares2 AS (SELECT h3_8, n * 1e0 / sum(n) OVER (PARTITION BY h3_8) AS p FROM types2),
    old AS (SELECT h3_8, sum(-p * log2(p)) AS raw, CAST(least(floor(least(sum(-p * log2(p)) / log2(10), 1e0) * 10), 9) AS INTEGER) AS bucket FROM shares2 GROUP BY 1)"""
_SEVEN = _F + f""", types7 AS (SELECT h3_7, feature_type, count(*) AS n FROM features GROUP BY 1, 2), shares7 AS (SELECT h3_7, n, n * 1e0 / sum(n) OVER (PARTITION BY h3_7) AS p FROM types7),
    metrics7 AS (SELECT h3_7, round(sum(-p * log2(p)), 6) AS e, {_VARIANCE} AS v FROM shares7 GROUP BY 1)"""
ORACLES = {
    "feature_type_case": f"{_F} SELECT feature_id, feature_type FROM features",
    "road_class_case": f"{_F} SELECT feature_id, road_class FROM features",
    "tag_map_extract": f"{_F} SELECT feature_id, highway, building, amenity, landuse, population FROM features",
    "quadtree_tile": f"{_F} SELECT feature_id, tile_z, tile_x, tile_y FROM features",
    "cell_ids": f"{_F} SELECT feature_id, h3_7, h3_8, h3_9, h3_10 FROM features",
    "source_filter": f"{_F} SELECT feature_id, country FROM tagged WHERE country = 'kenya'",
    "quadkey_prefix_filter": f"{_B} SELECT id, quadkey FROM buildings WHERE quadkey LIKE '1223%' OR quadkey LIKE '1232%' OR quadkey LIKE '1233%'",
    "quadkey_caller_prefix": f"{_B} SELECT id, quadkey FROM buildings WHERE quadkey LIKE '12021%'",
    "building_identity": f"{_B} SELECT 'building/' || id AS feature_id, occupancy, 'building' AS feature_type FROM buildings",
    "type_distribution": f"{_F} SELECT h3_8, feature_type, n FROM types",
    "cell_entropy": f"{_F} SELECT h3_8, entropy_score FROM bucketed",
    "cell_variance_bucket": f"{_F} SELECT h3_8, cell_variance, entropy_bucket FROM bucketed",
    "cell_density": f"{_F} SELECT h3_9, n FROM density",
    "importance_bytes": f"{_F} SELECT feature_id, neighbours, importance_byte FROM scored",
    "cell_metrics_join": f"{_F} SELECT feature_id, entropy_bucket, entropy_score, cell_variance FROM scored",
    "adaptive_resolution": f"{_SEVEN} SELECT h3_7, CASE WHEN e > 2 OR v > 0.25 THEN 10 WHEN e > 1 THEN 9 ELSE 7 END AS resolution FROM metrics7",
    "hysteresis": f"{_OLD} SELECT n.h3_8, CASE WHEN abs(n.entropy_score - round(o.raw, 6)) < 0.2e0 THEN o.bucket ELSE n.entropy_bucket END AS bucket FROM bucketed n LEFT JOIN old o USING (h3_8)",
    "partition_run_id": f"{_F} SELECT feature_id, substr(sha256(h3_8 || ':{MINUTE}'), 1, 16) AS partition_run_id FROM features",
    "bbox_zoom9": _bbox_sql(80, 500),
    "bbox_zoom12": _bbox_sql(40, 2000),
    "bbox_zoom15": _bbox_sql(0, 5000),
    "h3_cell_query": f"{_F} SELECT feature_id, importance_byte FROM scored WHERE h3_7 = '{_CELL7}' ORDER BY importance_byte DESC, feature_id LIMIT 5000",
    "features_in_polygon": f"{_F}{_inside('mid_lng', 'mid_lat')} SELECT feature_id, h3_9 FROM features JOIN crossed USING (o_orderkey) WHERE n % 2 = 1",
    "buildings_bbox": f"{_B} SELECT id, occupancy, area AS bbox_area_m2 FROM shaped WHERE {_IN} ORDER BY (xmax - xmin) * (ymax - ymin) DESC, id LIMIT 1000",
    "buildings_occupancy": f"{_B} SELECT id, occupancy FROM shaped WHERE {_IN} AND occupancy = 'RES' ORDER BY (xmax - xmin) * (ymax - ymin) DESC, id LIMIT 1000",
    "buildings_cells": f"{_B9} SELECT 'building/' || id AS feature_id, area AS area_m2 FROM celled WHERE {_IN9} ORDER BY area DESC, feature_id LIMIT 1000",
    "building_stats": f"{_B} SELECT {_COUNTS.format(h='height')} FROM shaped WHERE {_IN}",
    "building_stats_cells": f"{_B9} SELECT {_COUNTS.format(h='height_m')} FROM celled WHERE {_IN9}",
    "height_parse": f"{_B} SELECT id, height_m, round(height_floors, 6) AS height_floors FROM shaped",
    "height_parse_raw_path": f"{_B} SELECT id, CASE WHEN height LIKE 'HBET:%' THEN (p_size + 1) * 3e0 WHEN height LIKE 'H%' THEN NULL ELSE CAST(height AS DOUBLE) END AS height_m FROM shaped",
    "geojson_buildings": f"{_B} SELECT 'Feature' AS type, 'Point' AS geometry_type, id, CASE WHEN height LIKE 'HBET:%' THEN (p_size + 1) * 3e0 WHEN height LIKE 'H%' THEN NULL ELSE CAST(height AS DOUBLE) END AS height_m, area AS bbox_area_m2 FROM shaped",
    "tile_manifest": f"{_F}{_STATS} SELECT tile_z, tile_x, tile_y, feature_count, size_bytes, round(entropy, 4) AS entropy, CASE WHEN entropy > 1.5 AND size_bytes > 50000 THEN 'immediate' WHEN size_bytes < 5000 THEN 'defer' ELSE 'background' END AS fetch_priority, printf('z%d/%d/%d.parquet', tile_z, tile_x, tile_y) AS tile_path FROM tiles",
    "manifest_totals": f"{_F}{_STATS} SELECT count(*) AS tile_count, CAST(sum(feature_count) AS BIGINT) AS total_features FROM tiles",
    "distinct_tiles": f"{_F} SELECT DISTINCT tile_z, tile_x, tile_y FROM features",
    "adaptive_tiles": f"""{_F}, deep AS (SELECT CAST(floor((lng + 180e0) / 360e0 * 65536) AS INTEGER) AS x, CAST(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 65536) AS INTEGER) AS y FROM features),
        chains AS (SELECT x, y, CAST(z AS INTEGER) AS z, x >> CAST(16 - z AS INTEGER) AS tx, y >> CAST(16 - z AS INTEGER) AS ty FROM deep, range(6, 17) t(z)),
        held AS (SELECT z, tx, ty, count(*) AS n FROM chains GROUP BY ALL), tiled AS (SELECT c.x, c.y, c.z, c.tx, c.ty, h.n FROM (SELECT DISTINCT * FROM chains) c JOIN held h USING (z, tx, ty))
        SELECT DISTINCT z AS tile_z, tx AS tile_x, ty AS tile_y, n FROM tiled QUALIFY z = coalesce(min(CASE WHEN n <= 500 THEN z END) OVER (PARTITION BY x, y), 16)""",
    "top10_tiles": f"{_F}{_STATS} SELECT tile_x, tile_y, feature_count FROM tiles ORDER BY feature_count DESC, tile_x, tile_y LIMIT 10",
    "towns_bbox": f"{_F}, {_T[5:]}, {_BOXES} SELECT key, round(sw_lng, 6) AS sw_lng, round(sw_lat, 6) AS sw_lat, round(ne_lng, 6) AS ne_lng, round(ne_lat, 6) AS ne_lat, count(f.lng) AS n FROM boxes LEFT JOIN features f ON f.lng BETWEEN sw_lng AND ne_lng AND f.lat BETWEEN sw_lat AND ne_lat GROUP BY ALL",
    "towns_buildings_link": f"{_B}, {_T[5:]}, ours AS (SELECT 'kenya' AS dataset_key, count(*) FILTER (WHERE {_KE}) AS n FROM buildings UNION ALL SELECT 'canary', count(*) FILTER (WHERE quadkey LIKE '1202%' OR quadkey LIKE '1203%') FROM buildings) SELECT key, CASE dataset_key WHEN 'kenya' THEN 'kenya-buildings' WHEN 'canary' THEN 'canary-buildings' END AS building_key, CASE WHEN dataset_key IS NOT NULL THEN 14 END AS zoom_gate, n FROM towns LEFT JOIN ours USING (dataset_key)",
    "town_viewport_counts": f"{_F}, {_T[5:]}, {_BOXES} SELECT key, count(*) AS n FROM features f JOIN boxes b ON f.lng BETWEEN sw_lng AND ne_lng AND f.lat BETWEEN sw_lat AND ne_lat GROUP BY key",
    "zoom_describe": "SELECT o_orderkey, CAST(z AS INTEGER) AS zoom, CASE WHEN z <= 6 THEN 'continental' WHEN z <= 9 THEN 'metro' WHEN z <= 12 THEN 'city' WHEN z <= 15 THEN 'neighborhood' ELSE 'street' END AS semantic_level, CASE WHEN z <= 10 THEN 7 WHEN z <= 12 THEN 8 WHEN z <= 14 THEN 9 ELSE 10 END AS h3_resolution, CASE WHEN z <= 9 THEN 500 WHEN z <= 12 THEN 2000 ELSE 5000 END AS feature_limit, CASE WHEN z <= 9 THEN 80 WHEN z <= 12 THEN 40 ELSE 0 END AS importance_threshold FROM (SELECT o_orderkey, o_orderkey % 21 AS z FROM orders)",
    "haversine_nearest": f"{_F}, a AS (SELECT feature_id, sin(radians(-1.2921e0 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(-1.2921e0)) * sin(radians(36.8219e0 - lng) / 2) ** 2 AS a FROM features) SELECT feature_id, round(2 * 6371000e0 * atan2(sqrt(a), sqrt(1 - a)), 3) AS meters FROM a ORDER BY meters, feature_id LIMIT 20",
    "geodesics": f"""{_F}, {_vincenty_sql("away", "SELECT feature_id AS id, lat AS lat1, lng AS lng1, -1.2921e0 AS lat2, 36.8219e0 AS lng2 FROM features")},
        {_vincenty_sql("own", "SELECT feature_id AS id, lat AS lat1, 0e0 AS lng1, lat AS lat2, 0.01e0 AS lng2 FROM features")}, {_vincenty_sql("coast", "SELECT 0 AS id, -4.0435e0 AS lat1, 0e0 AS lng1, -4.0435e0 AS lat2, 0.01e0 AS lng2")}
        SELECT away.id AS feature_id, round(away.meters, 2) AS meters, round(own.meters / coast.meters, 6) AS growth FROM away JOIN own ON own.id = away.id, coast""",
    "bbox_area": f"{_B} SELECT id, round((xmax - xmin) * 111320e0 * cos(radians((ymin + ymax) / 2)) * (ymax - ymin) * 110574e0 / 1e6, 9) AS area_km2 FROM shaped",
    "features_and_buildings": f"{_F} SELECT feature_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT feature_type, count(*) AS n FROM features GROUP BY 1 UNION ALL SELECT 'building', count(*) FROM part) GROUP BY 1",
    "lake_roundtrip": f"{_F} SELECT tile_z, tile_x, tile_y, count(*) AS n, CAST(sum(importance_byte) AS BIGINT) AS importance FROM scored GROUP BY 1, 2, 3",
    "manifest_entries": f"{_F}{_STATS} SELECT tile_z, tile_x, tile_y, feature_count, size_bytes, CASE WHEN entropy > 1.5 AND size_bytes > 50000 THEN 'immediate' WHEN size_bytes < 5000 THEN 'defer' ELSE 'background' END AS fetch_priority, printf('ke/z%d/%d/%d.parquet', tile_z, tile_x, tile_y) AS url FROM tiles",
    "flat_cells_export": "SELECT CAST(p_partkey AS VARCHAR) AS cellId, 9 AS resolution, round(((p_partkey * 104729) % 30011) / 1e5 - 1.45e0, 6) AS lat, round(((p_partkey * 7919) % 30011) / 1e5 + 36.65e0, 6) AS lng, CASE WHEN p_partkey % 3 <> 0 THEN printf('{\"size\":%d}', p_size) ELSE '{}' END AS properties FROM part",
    "wkb_shapes": f"{_UTM} SELECT id, round(lng, 6) AS lng, round(lat, 6) AS lat, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax, round(utm_area, 1) AS area_m2, round(perimeter, 2) AS perimeter_m FROM shaped JOIN outlines USING (id)",
    "wkb_in_box": f"{_B} SELECT id FROM shaped WHERE xmin <= 36.90e0 AND xmax >= 36.70e0 AND ymin <= -1.20e0 AND ymax >= -1.40e0",
    "stage_features": f"{_F} SELECT feature_id, feature_type, country AS country_code, round(lng, 6) AS centroid_lng, round(lat, 6) AS centroid_lat, tile_z, tile_x, tile_y, CAST(21 AS BIGINT) AS compressed_size_bytes FROM features WHERE country = 'kenya' AND lng BETWEEN 36.70e0 AND 36.90e0 AND lat BETWEEN -1.40e0 AND -1.20e0",
    "stage_buildings": f"{_UTM} SELECT 'building/' || id AS feature_id, 'OSM' AS source_provider, round(height_m, 6) AS height_m, round(height_floors, 6) AS height_floors, round(utm_area, 1) AS area_m2, round(perimeter, 2) AS perimeter_m, {_tile10('lng', 'lat')}, CAST(93 AS BIGINT) AS compressed_size_bytes FROM shaped JOIN outlines USING (id) WHERE {_KE}",
    "geojson_features": f"{_F} SELECT 'Feature' AS type, feature_id, importance_byte, round(lng, 6) AS lng, round(lat, 6) AS lat FROM scored",
    "geojson_enriched": f"{_B} SELECT 'building/' || id AS id, 'Polygon' AS geometry_type, round(xmax, 6) AS lng, round(ymax, 6) AS lat, round(height_m, 6) AS height_m, 'OSM' AS source FROM shaped WHERE {_KE}",
}
