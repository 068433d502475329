"""Zoom levels: resolutions, semantic labels and limits, as plain functions of a zoom."""

from __future__ import annotations

import math

# Mean cell areas (km2) and edge lengths (m) of hexagonal grid resolutions 0 to 15.
CELL_AREA_KM2 = [4250546.848, 607220.978, 86745.854, 12392.264, 1770.324, 252.903, 36.129, 5.162, 0.737, 0.105, 0.015, 0.00216, 0.000309, 0.0000441, 0.0000063, 0.0000009]
CELL_EDGE_M = [1107712.591, 418676.005, 158244.655, 59800.888, 22606.379, 8544.408, 3229.482, 1220.629, 461.354, 174.375, 65.907, 24.910, 9.415, 3.559, 1.348, 0.509]
# Scale denominators at the equator of zooms 0 to 19.
SCALE_DENOMINATOR = [
    591657550.5, 295828775.3, 147914387.6, 73957193.82, 36978596.91, 18489298.45, 9244649.227, 4622324.614, 2311162.307, 1155581.153,
    577790.5767, 288895.2884, 144447.6442, 72223.82209, 36111.91104, 18055.95552, 9027.977761, 4513.98888, 2256.99444, 1128.49722,
]
# Zooms served by a resolution, and the labels up to a zoom.
ZOOMS_OF_RESOLUTION = {7: (9, 10), 8: (11, 12), 9: (13, 14), 10: (15, 16)}
LABELS = [(6, "continental"), (9, "metro"), (12, "city"), (15, "neighborhood")]
M_PER_DEG_LNG, M_PER_DEG_LAT = 111320.0, 110574.0


def _known(zoom: int) -> int:
    if not 0 <= zoom <= 20:
        raise ValueError(f"zoom {zoom} is outside 0..20")
    return zoom


def scale_denominator(zoom: int) -> float:
    """The table's value; zoom 20 halves zoom 19."""
    return SCALE_DENOMINATOR[19] / 2 if _known(zoom) == 20 else SCALE_DENOMINATOR[zoom]


def m_per_px(zoom: int, lat: float = 0.0) -> float:
    """True metres per pixel at 96 dots an inch."""
    return scale_denominator(zoom) * 0.0254 / 96 * math.cos(math.radians(lat))


def ground_resolution(zoom: int, lat: float = 0.0) -> float:
    """The table's value times cos(lat), as the service reports it."""
    return scale_denominator(zoom) * math.cos(math.radians(lat))


def ground_resolution_ratio(zoom_a: int, zoom_b: int) -> float:
    return scale_denominator(zoom_a) / scale_denominator(zoom_b)


def resolution_for_zoom(zoom: int) -> int:
    z = min(max(zoom, 0), 20)
    return 7 if z <= 10 else 8 if z <= 12 else 9 if z <= 14 else 10


def column_for_zoom(zoom: int) -> str:
    return f"h3_{resolution_for_zoom(zoom)}"


def zooms_for_resolution(resolution: int) -> tuple[int, int]:
    if resolution not in ZOOMS_OF_RESOLUTION:
        raise ValueError(f"no zooms for resolution {resolution}")
    return ZOOMS_OF_RESOLUTION[resolution]


def semantic_level(zoom: int) -> str:
    return next((label for top, label in LABELS if 0 <= zoom <= top), "street")


def feature_limit(zoom: int | None) -> int:
    return 5000 if zoom is None or zoom > 12 else 500 if zoom <= 9 else 2000


def importance_threshold(zoom: int | None, calibrated: bool = False) -> int:
    """Least importance byte at a zoom. Calibrated thresholds suit features without an area, whose bytes end at 77."""
    high, mid = (60, 30) if calibrated else (80, 40)
    return 0 if zoom is None or zoom > 12 else high if zoom <= 9 else mid


def pixels_to_degrees_lng(zoom: int, lat: float, pixels: int) -> float:
    return ground_resolution(zoom, lat) * pixels / (M_PER_DEG_LNG * math.cos(math.radians(lat)))


def pixels_to_degrees_lat(zoom: int, lat: float, pixels: int) -> float:
    return ground_resolution(zoom, lat) * pixels / M_PER_DEG_LAT


def viewport_extent_degrees(zoom: int, lat: float, width_px: int, height_px: int) -> tuple[float, float]:
    """Half extents (lat, lng)."""
    return pixels_to_degrees_lat(zoom, lat, height_px // 2), pixels_to_degrees_lng(zoom, lat, width_px // 2)


def describe(zoom: int, lat: float = 0.0) -> dict:
    res = resolution_for_zoom(_known(zoom))
    return {
        "zoom": zoom, "lat": lat, "semantic_level": semantic_level(zoom), "ground_resolution_equatorial_m": scale_denominator(zoom),
        "ground_resolution_corrected_m": round(ground_resolution(zoom, lat), 3), "latitude_scale_factor": round(math.cos(math.radians(lat)), 6),
        "h3_resolution": res, "h3_column": f"h3_{res}", "h3_edge_length_m": CELL_EDGE_M[res], "h3_cell_area_km2": CELL_AREA_KM2[res],
    }


def parse_zoom_table(text: str) -> dict[int, float]:
    """Lines of `zoom : value`; an empty table is an error."""
    out = {}
    for line in text.splitlines():
        left, colon, right = line.partition(":")
        if colon and left.strip():
            out[int(left)] = float(right)
    if not out:
        raise ValueError("the zoom table is empty")
    return out
