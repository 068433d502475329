"""Staging of source rows, cell metrics, densities and importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, h3, scoring, wkb
from ..sources.registry import BuildingDataset, Dataset
from ..sources.shared import bounded_join

RESOLUTIONS = (7, 8, 9, 10)


def with_cells(df: DataFrame, lat: str = "centroid_lat", lng: str = "centroid_lng", zoom: int = 10) -> DataFrame:
    """df with its cells of RESOLUTIONS, all from one pass over the points, and its tile."""
    df = df.withColumn("_cells", h3.points_to_cells(RESOLUTIONS)(F.col(lat), F.col(lng)))
    cells = {f"h3_{r}": F.lower(F.hex(F.col("_cells")[f"r{r}"])) for r in RESOLUTIONS}
    return df.withColumns(cells | {"tile_z": F.lit(zoom), "tile_x": geo.tile_x(F.col(lng), zoom), "tile_y": geo.tile_y(F.col(lat), zoom)}).drop("_cells")


def stage_features(source: DataFrame, dataset: Dataset, zoom: int = 10, normalize_country: bool = False, order_by: int = 8) -> DataFrame:
    """Map-feature rows (feature_id, tags, geometry or geom, country) with all columns that need no other row."""
    if "geom" in source.columns and "geometry" not in source.columns:
        source = source.withColumnRenamed("geom", "geometry")
    x = source.filter(dataset.source_filter())
    if dataset.bbox:
        x = x.filter(wkb.meets_box_udf(dataset.bbox)(F.col("geometry")))
    tags = F.col("tags")
    x = x.withColumn("_s", wkb.shape_udf()(F.col("geometry"))).select(
        "feature_id", scoring.feature_type(tags).alias("feature_type"), "geometry", F.col("_s.lat").alias("centroid_lat"), F.col("_s.lng").alias("centroid_lng"),
        (F.lit(dataset.country) if normalize_country else F.col("country")).alias("country_code"), *[tags[k].alias(k) for k in ("highway", "building", "amenity", "landuse")],
        scoring.try_int(tags["population"]).alias("population"), scoring.road_class(tags["highway"]).alias("road_class"), F.lit(None).cast("string").alias("occupancy"), F.lit(None).cast("double").alias("area_m2"),
    )
    return _finish(x, zoom, order_by)


def stage_buildings(source: DataFrame, dataset: BuildingDataset, zoom: int = 10, prefix: str | None = None, order_by: int = 8) -> DataFrame:
    """Building rows with discrete columns; area and perimeter in the dataset's UTM zone."""
    x = source.filter(dataset.quadkey_filter(prefix)).filter(F.col("geometry").isNotNull())
    x = x.withColumn("_s", wkb.shape_udf(dataset.utm_epsg)(F.col("geometry"))).select(
        F.concat(F.lit("building/"), F.col("id").cast("string")).alias("feature_id"), F.lit("building").alias("feature_type"), "geometry", F.col("_s.lat").alias("centroid_lat"), F.col("_s.lng").alias("centroid_lng"),
        F.lit(dataset.country).alias("country_code"), *[F.lit(None).cast("string").alias(c) for c in ("highway", "building", "amenity", "landuse")], F.lit(None).cast("int").alias("population"), F.lit(None).cast("byte").alias("road_class"),
        F.col("floorspace").cast("string").alias("floorspace"), "occupancy", F.col("height").alias("height_raw"), scoring.height_m(F.col("height")).alias("height_m"), scoring.height_floors(F.col("height")).alias("height_floors"),
        "quadkey", "relation_id", F.col("source").alias("source_provider"), F.col("_s.area_m2").alias("area_m2"), F.col("_s.perimeter_m").alias("perimeter_m"),
    )
    return _finish(x, zoom, order_by)


def _finish(x: DataFrame, zoom: int, order_by: int = 8) -> DataFrame:
    """Cells, tile, the key of the row order (by the cell of resolution order_by) and the geometry's size."""
    x = with_cells(x, zoom=zoom)
    return x.withColumn("zorder_key", scoring.zorder_key(geo.cell_to_long(F.col(f"h3_{order_by}")), F.col("feature_id"))).withColumn("compressed_size_bytes", F.coalesce(F.octet_length("geometry"), F.lit(0)).cast("long"))


def type_distribution(features: DataFrame, cell: str = "h3_8") -> DataFrame:
    """cell, feature_type, n. Both this and what follows are partial aggregates, so a hot cell costs a row per task."""
    return features.filter(F.col(cell).isNotNull()).groupBy(cell, "feature_type").agg(F.count(F.lit(1)).alias("n"))


def cell_metrics(features: DataFrame, cell: str = "h3_8", digits: int = 6) -> DataFrame:
    """Per cell: n, entropy in bits, variance of the type shares, bucket; two aggregations and no join.

    With N = sum n over k types: entropy = log2 N - sum(n log2 n) / N, and the population variance of the shares n / N is
    (k * sum n^2 - N^2) / (k * N)^2: whole numbers, so the order in which partial sums merge can't change its last digit.
    """
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    per = type_distribution(features, cell).withColumn("x", F.col("n") * F.log2(F.col("n").cast("double")))
    agg = per.groupBy(cell).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum(exact("n") * exact("n")).alias("s2"))
    raw = F.greatest(F.lit(0.0), F.log2(F.col("n").cast("double")) - F.col("x") / F.col("n"))
    variance = _rounded(F.col("k") * F.col("s2") - exact("n") * exact("n"), F.col("k") * F.col("n"), digits)
    agg = agg.withColumn("raw", F.when(F.abs(raw) < 1e-12, 0.0).otherwise(raw))
    return agg.select(cell, "n", F.round("raw", digits).alias("entropy_score"), variance.alias("cell_variance"), scoring.entropy_bucket(F.col("raw")).alias("entropy_bucket"))


def _rounded(top: Column, root: Column, digits: int) -> Column:
    """top / root^2 as a double of so many digits, halves up, in whole numbers of up to 38 digits; in doubles for roots of 10^12 and more."""
    small = F.when(root < 10**12, root).otherwise(1).cast("decimal(13,0)")
    square = (small * small).cast("decimal(26,0)")
    scaled = F.when(root < 10**12, top).otherwise(0).cast("decimal(27,0)") * F.lit(2 * 10**digits)
    whole = F.call_function("div", scaled + square, square * F.lit(2)).cast("double") / float(10**digits)
    return F.when(root < 10**12, whole).otherwise(F.round(top.cast("double") / root.cast("double") / root.cast("double"), digits))


def cell_density(features: DataFrame, cell: str = "h3_9") -> DataFrame:
    return features.filter(F.col(cell).isNotNull()).groupBy(cell).agg(F.count(F.lit(1)).alias("n"))


def with_importance(features: DataFrame, cell: str = "h3_9", density: DataFrame | None = None) -> DataFrame:
    """neighbours (others in the cell; 0 without a cell), importance and importance_byte. density: counts of more features than these.

    Density is joined, not windowed: a window would sort all features of a hot cell in one task.
    """
    density = (cell_density(features, cell) if density is None else density).withColumnRenamed("n", "_n")
    x = features.join(density, cell, "left").withColumn("neighbours", F.greatest(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).drop("_n")
    score = scoring.importance(F.col("area_m2"), F.col("building"), F.col("amenity"), F.col("occupancy"), F.col("neighbours"))
    return x.withColumn("importance", score).withColumn("importance_byte", scoring.importance_byte(F.col("importance")))


def damped(metrics: DataFrame, previous: DataFrame, cell: str = "h3_8") -> DataFrame:
    """Cell metrics whose buckets stay as previous (cell, entropy_score, entropy_bucket) has them while the entropy moves little."""
    old = previous.select(cell, F.col("entropy_score").alias("_e"), F.col("entropy_bucket").alias("_b"))
    bucket = scoring.hysteresis(F.col("entropy_score"), F.col("_e"), F.col("entropy_bucket"), F.col("_b"))
    return metrics.join(old, cell, "left").withColumn("entropy_bucket", bucket).drop("_e", "_b")


def enrich(staged: DataFrame, minute: str, adaptive: bool = False, previous: DataFrame | None = None, metrics: DataFrame | None = None, density: DataFrame | None = None) -> DataFrame:
    """All metric columns. adaptive adds preferred_resolution; previous (h3_8, entropy_score, entropy_bucket) damps bucket changes.

    metrics and density: of cells, where they are known or come from more features than staged.
    """
    m = (cell_metrics(staged) if metrics is None else metrics).drop("n")
    if previous is not None:
        m = damped(m, previous)
    x = with_importance(staged, density=density).join(m, "h3_8", "left")
    x = x.withColumns({
        "entropy_score": F.coalesce("entropy_score", F.lit(0.0)), "cell_variance": F.coalesce("cell_variance", F.lit(0.0)), "entropy_bucket": F.coalesce("entropy_bucket", F.lit(5)),
        "partition_run_id": scoring.partition_run_id(F.col("h3_8"), minute),
    })
    return x.withColumn("preferred_resolution", scoring.adaptive_resolution(F.col("entropy_score"), F.col("cell_variance"))) if adaptive else x


def tile_levels(features: DataFrame, least: int, deepest: int) -> DataFrame:
    """level, x, y and n: features of every tile that has some, from zoom least to deepest. One aggregation at the deepest zoom, folded upwards."""
    at = features.select(geo.tile_x(F.col("centroid_lng"), deepest).alias("x"), geo.tile_y(F.col("centroid_lat"), deepest).alias("y"))
    counts = at.filter("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    up = counts.withColumn("level", F.explode(F.sequence(F.lit(least), F.lit(deepest))))
    shift = lambda c: F.call_function("shiftright", F.col(c), F.lit(deepest) - F.col("level"))
    return up.select("level", shift("x").alias("x"), shift("y").alias("y"), "n").groupBy("level", "x", "y").agg(F.sum("n").alias("n"))


def adaptive_tiles(features: DataFrame, target: int, least: int = 4, deepest: int = 16) -> DataFrame:
    """tile_z, tile_x, tile_y and n: the tiles that part the features into parts of at most target each, as shallow as that allows.

    A tile is a leaf if it holds at most target features and its parent more, or if it is of zoom least; a tile of the deepest
    zoom is one whatever it holds. Dense tiles are split so, and sparse ones merged.
    """
    levels = tile_levels(features, least, deepest)
    half = lambda c: F.shiftright(c, 1)
    full = levels.filter(F.col("n") > target).select((F.col("level") + 1).alias("level"), F.col("x").alias("px"), F.col("y").alias("py"))
    below = levels.withColumns({"px": half("x"), "py": half("y")}).join(full, ["level", "px", "py"], "left_semi")
    reached = levels.filter(F.col("level") == least).unionByName(below.select(*levels.columns))
    leaves = reached.filter((F.col("n") <= target) | (F.col("level") == deepest))
    return leaves.select(F.col("level").alias("tile_z"), F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), "n")


def with_adaptive_tiles(features: DataFrame, leaves: DataFrame, least: int = 4, deepest: int = 16) -> DataFrame:
    """features with the leaf that holds each as its tile; leaves is a written table. Rows without a place keep the tile that they have."""
    zooms = sorted(r.tile_z for r in leaves.select("tile_z").distinct().toLocalIterator())
    x, y = geo.tile_x(F.col("centroid_lng"), deepest), geo.tile_y(F.col("centroid_lat"), deepest)
    spots = [F.struct(F.lit(z).alias("tile_z"), F.shiftright(x, deepest - z).alias("tile_x"), F.shiftright(y, deepest - z).alias("tile_y")) for z in zooms]
    if not spots:
        return features
    keys = ["tile_z", "tile_x", "tile_y"]
    placed = features.filter(x.isNotNull() & y.isNotNull()).drop(*keys).withColumn("_t", F.explode(F.array(*spots))).select("*", "_t.*").drop("_t")
    found = bounded_join(placed, leaves.select(*keys), keys, "left_semi")  # a point lies in one leaf
    rest = features.filter(x.isNull() | y.isNull())
    return found.select(*features.columns).unionByName(rest)
