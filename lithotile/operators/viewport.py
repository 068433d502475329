"""Viewport queries: boxes, cells, buildings, statistics; their validators and GeoJSON encoders."""

from __future__ import annotations

import logging
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import h3, scoring, wkb, zoom as Z
from ..sources.lake import tile_range
from ..sources.registry import BuildingDataset
from ..sources.shared import bounded_join

log = logging.getLogger("lithotile")
#: Resolutions whose cells the lake stores.
STORED = (7, 8, 9, 10)
Box = tuple[float, float, float, float]


class QueryError(ValueError):
    """A request that is refused before any job runs."""

    def __init__(self, message: str, code: str = "VALIDATION_ERROR", **details):
        super().__init__(message)
        self.code, self.details = code, details

    def envelope(self) -> dict:
        return {"error": {"code": self.code, "message": str(self), "details": self.details}}


def error_envelope(error: Exception) -> dict:
    """What a service answers for an error: a refused request by its own code, an unknown name as not found, anything else without details."""
    if isinstance(error, QueryError):
        return error.envelope()
    if isinstance(error, FileNotFoundError):
        return QueryError(str(error), "NOT_FOUND").envelope()
    if isinstance(error, (ValueError, KeyError)):
        return QueryError(str(error)).envelope()
    log.error("internal error", exc_info=error)
    return QueryError("internal error", "INTERNAL_ERROR", kind=type(error).__name__).envelope()


def check_box(box: Box, widest: float = 10.0) -> Box:
    sw_lng, sw_lat, ne_lng, ne_lat = box
    if not (-180 <= sw_lng <= 180 and -180 <= ne_lng <= 180 and -90 <= sw_lat <= 90 and -90 <= ne_lat <= 90):
        raise QueryError("coordinates outside the world")
    if sw_lng >= ne_lng or sw_lat >= ne_lat:
        raise QueryError("the south-west corner must lie south-west of the north-east one")
    if ne_lng - sw_lng > widest or ne_lat - sw_lat > widest:
        raise QueryError(f"the box is wider than {widest:g} degrees")
    return box


def check_limit(limit: int | None) -> int | None:
    if limit is not None and not 1 <= limit <= 10_000:
        raise QueryError("limit must lie in 1..10000")
    return limit


def check_cell(cell: str) -> str:
    if not re.fullmatch(r"[0-9a-f]{15,16}", cell):
        raise QueryError(f"{cell!r} is no cell id")
    return cell


def check_zoom(zoom: int | None) -> int | None:
    if zoom is not None and not 0 <= zoom <= 20:
        raise QueryError("zoom must lie in 0..20")
    return zoom


def check_gate(zoom: int, dataset: BuildingDataset) -> None:
    if zoom < dataset.zoom_gate:
        raise QueryError(f"buildings are served from zoom {dataset.zoom_gate}", "ZOOM_GATE", zoom=zoom, required=dataset.zoom_gate)


def top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """Top rows by distributed top-k; feature ids break ties."""
    return df.orderBy(*order).limit(limit)


def _limit(zoom: int | None, limit: int | None) -> int:
    return min(Z.feature_limit(zoom), limit or 10_000)


def _important(df: DataFrame, zoom: int | None) -> DataFrame:
    n = Z.importance_threshold(zoom)
    return df.filter(F.col("importance_byte") >= n) if n else df


def in_box(box: Box, lat: str = "centroid_lat", lng: str = "centroid_lng") -> Column:
    """Boundary inclusive, in plain comparisons, so it reaches the Parquet scan."""
    return F.col(lng).between(box[0], box[2]) & F.col(lat).between(box[1], box[3])


def query_bbox(features: DataFrame, box: Box, zoom: int | None = None, limit: int | None = None, tile_zoom: int | None = None) -> DataFrame:
    """Features of a box by entropy bucket and importance. tile_zoom adds a filter on the tile columns."""
    check_box(box), check_zoom(zoom), check_limit(limit)
    x = features.filter(tile_range(box, tile_zoom)) if tile_zoom is not None else features
    return top(_important(x.filter(in_box(box)), zoom), _limit(zoom, limit), F.asc_nulls_last("entropy_bucket"), F.desc_nulls_last("importance_byte"), F.asc("feature_id"))


def query_h3(features: DataFrame, cell: str, resolution: int | None = None, zoom: int | None = None, limit: int | None = None) -> DataFrame:
    """Features of a cell; the resolution given, else the zoom's, else 8."""
    check_cell(cell), check_zoom(zoom), check_limit(limit)
    resolution = resolution if resolution is not None else Z.resolution_for_zoom(zoom) if zoom is not None else 8
    if resolution not in STORED:
        raise QueryError(f"resolution {resolution} is not stored")
    return top(_important(features.filter(F.col(f"h3_{resolution}") == cell), zoom), _limit(zoom, limit), F.desc_nulls_last("importance_byte"), F.asc("feature_id"))


def overlaps(box: Box, column: str = "bbox") -> Column:
    b = F.col(column)
    return (b["xmin"] <= box[2]) & (b["xmax"] >= box[0]) & (b["ymin"] <= box[3]) & (b["ymax"] >= box[1])


def query_buildings(buildings: DataFrame, dataset: BuildingDataset, box: Box, zoom: int, *, occupancy: str | None = None, quadkey: str | None = None, limit: int = 1000, mode: str = "cells") -> DataFrame:
    """Enriched rows of the cells whose centre lies in the box (mode="box": rows whose centroid does), by area; raw rows whose boxes overlap it, by size in degrees."""
    x = _in_view(buildings, dataset, box, zoom, occupancy, quadkey, mode)
    check_limit(limit)
    if dataset.h3_enriched:
        return top(x, limit, F.desc_nulls_last("area_m2"), F.asc("feature_id"))
    b = F.col("bbox")
    return top(x, limit, F.desc_nulls_last((b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"])), F.asc("id"))


def _in_view(buildings: DataFrame, dataset: BuildingDataset, box: Box, zoom: int, occupancy: str | None, quadkey: str | None, mode: str) -> DataFrame:
    check_gate(zoom, dataset), check_box(box)
    if max(box[2] - box[0], box[3] - box[1]) > 0.5:
        log.warning("a wide building viewport: %s", box)
    if dataset.h3_enriched:
        x = in_cells(buildings, ring(box), 9) if mode == "cells" else buildings.filter(in_box(box))
    else:
        x = buildings.filter(overlaps(box)).filter(dataset.quadkey_filter(quadkey))
    return x.filter(F.col("occupancy") == occupancy) if occupancy else x


def ring(box: Box) -> list[list[tuple[float, float]]]:
    return [[(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]]


def in_cells(rows: DataFrame, rings: list[list[tuple[float, float]]], res: int) -> DataFrame:
    """Rows of the cells of a resolution whose centre lies in a polygon of rings of (lng, lat).

    The cells are a table, which is broadcast only if it is small. Centroids lie in their cell, so a box around the polygon's
    cells is a filter that reaches the scan; there is none for a polygon near a pole or across the antimeridian.
    """
    area = h3.Area(rings)
    if area.box is not None and not area.crosses and (wide := around_cells(area.box, res)):
        rows = rows.filter(in_box(wide))
    cells = h3.cells_in_polygon(rows.sparkSession, rings, res).withColumnRenamed("cell", f"h3_{res}")
    return bounded_join(rows, cells, [f"h3_{res}"], "left_semi")


def around_cells(box: Box, res: int) -> Box | None:
    """A box that holds all points of the cells whose centre lies in a box; None near a pole or the antimeridian."""
    up = 0.65 * h3.spacing_degrees(res)
    far = max(abs(box[1]), abs(box[3])) + up
    if far >= 89:
        return None
    side = up / math.cos(math.radians(far))
    return (box[0] - side, box[1] - up, box[2] + side, box[3] + up) if -180 <= box[0] - side and box[2] + side <= 180 else None


def occupancy_counts(rows: DataFrame, height: str) -> DataFrame:
    """One row: total, one count for each occupancy, with_height."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("occupancy") == o).alias(o.lower()) for o in ("RES", "COM", "IND", "CIV", "UNK")], F.count_if(F.col(height).isNotNull()).alias("with_height"))


def building_stats(buildings: DataFrame, dataset: BuildingDataset, box: Box, zoom: int, *, occupancy: str | None = None, quadkey: str | None = None) -> DataFrame:
    return occupancy_counts(_in_view(buildings, dataset, box, zoom, occupancy, quadkey, "cells"), "height_m" if dataset.h3_enriched else "height")


def in_viewports(points: DataFrame, viewports: DataFrame, lat: str = "centroid_lat", lng: str = "centroid_lng", degrees: float = 0.25) -> DataFrame:
    """Points joined with the viewports (key, sw_lng, sw_lat, ne_lng, ne_lat) that hold them.

    The range join is an equi-join on grid squares: a viewport is listed in each square that it meets (it is 10 degrees wide
    at most), a point has one square, and the exact test follows.
    """
    grid = lambda c: F.floor(c / degrees)
    v = viewports.withColumn("_gx", F.explode(F.sequence(grid(F.col("sw_lng")), grid(F.col("ne_lng"))))).withColumn("_gy", F.explode(F.sequence(grid(F.col("sw_lat")), grid(F.col("ne_lat")))))
    p = points.withColumn("_gx", grid(F.col(lng))).withColumn("_gy", grid(F.col(lat)))
    return p.join(v, ["_gx", "_gy"]).filter(F.col(lng).between(F.col("sw_lng"), F.col("ne_lng")) & F.col(lat).between(F.col("sw_lat"), F.col("ne_lat"))).drop("_gx", "_gy")


_PROPERTIES = ["feature_id", "feature_type", "country_code", "h3_7", "h3_8", "h3_9", "h3_10", "tile_z", "tile_x", "tile_y", "entropy_score", "importance_byte", "entropy_bucket", "highway", "building", "amenity", "landuse", "road_class"]
_KEEP = {"ignoreNullFields": "false"}


def _point(lng: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))


def encode_features(df: DataFrame) -> DataFrame:
    """type, geometry and properties as JSON; the stored centroid spares a geometry decode."""
    return df.select(F.lit("Feature").alias("type"), F.to_json(_point(F.col("centroid_lng"), F.col("centroid_lat"))).alias("geometry"), F.to_json(F.struct(*_PROPERTIES), _KEEP).alias("properties"))


def bbox_center(column: str = "bbox") -> tuple[Column, Column]:
    b = F.col(column)
    return (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2


def bbox_area_m2(column: str = "bbox") -> Column:
    b = F.col(column)
    return F.round(F.abs(b["xmax"] - b["xmin"]) * Z.M_PER_DEG_LNG * F.cos(F.radians(bbox_center(column)[1])) * F.abs(b["ymax"] - b["ymin"]) * Z.M_PER_DEG_LAT, 1)


def encode_raw_buildings(df: DataFrame) -> DataFrame:
    p = F.struct("id", "occupancy", F.col("height").alias("height_raw"), scoring.height_m_raw_path(F.col("height")).alias("height_m"), "floorspace", "relation_id", "quadkey", F.col("last_update").cast("string").alias("last_update"), "source", bbox_area_m2().alias("bbox_area_m2"))
    return df.select(F.lit("Feature").alias("type"), F.to_json(_point(*bbox_center())).alias("geometry"), F.to_json(p, _KEEP).alias("properties"))


def encode_buildings(df: DataFrame) -> DataFrame:
    p = F.struct(F.col("feature_id").alias("id"), "occupancy", "height_raw", "height_m", "height_floors", "floorspace", "relation_id", "quadkey", F.col("source_provider").alias("source"), "area_m2", "perimeter_m", "h3_9")
    return df.select(F.lit("Feature").alias("type"), wkb.wkb_to_geojson("geometry").alias("geometry"), F.to_json(p, _KEEP).alias("properties"))
