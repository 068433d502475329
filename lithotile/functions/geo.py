"""Geographic functions on columns: tiles, distances and areas. No UDF but for geodesics, so filters and projections stay in codegen."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import zoom as Z

EARTH_M = 6_371_000.0
#: Latitude of the upper edge of the Web-Mercator square.
MERCATOR_LAT = 85.0511287798066


def tile_x(lng: Column, zoom: int) -> Column:
    return F.floor((lng + 180.0) / 360.0 * float(1 << zoom)).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return F.floor((1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * float(1 << zoom)).cast("int")


def tile_of(lng: float, lat: float, zoom: int) -> tuple[int, int]:
    """Latitudes beyond the square of the projection count as its edge."""
    n, r = 1 << zoom, math.radians(max(-MERCATOR_LAT, min(MERCATOR_LAT, lat)))
    x, y = (lng + 180.0) / 360.0 * n, (1.0 - math.log(math.tan(r) + 1.0 / math.cos(r)) / math.pi) / 2.0 * n
    return max(0, min(n - 1, math.floor(x))), max(0, min(n - 1, math.floor(y)))


def cell_to_long(cell_hex: Column) -> Column:
    """The integer of a cell's hex digits; cells lie below 2^63."""
    return F.conv(cell_hex, 16, 10).cast("long")


def degrees_to_meters_lng(lat: Column, deg: Column) -> Column:
    return deg * Z.M_PER_DEG_LNG * F.cos(F.radians(lat))


def degrees_to_meters_lat(deg: Column) -> Column:
    return deg * Z.M_PER_DEG_LAT


def meters_to_degrees_lng(lat: Column, m: Column, strict: bool = False) -> Column:
    """At the poles, where a degree has no length: null, or with strict an error."""
    c = F.cos(F.radians(lat))
    x = F.when(F.abs(c) >= 1e-10, m / (Z.M_PER_DEG_LNG * c))
    return x.otherwise(F.when(lat.isNotNull(), F.raise_error(F.lit("no longitude at the poles")).cast("double"))) if strict else x


def meters_to_degrees_lat(m: Column) -> Column:
    return m / Z.M_PER_DEG_LAT


def latitude_scale_factor(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2.0) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2.0)
    return F.atan2(F.sqrt(a), F.sqrt(1.0 - a)) * (2.0 * EARTH_M)


def bbox_area_km2(sw_lng: Column, sw_lat: Column, ne_lng: Column, ne_lat: Column) -> Column:
    return degrees_to_meters_lng((sw_lat + ne_lat) / 2, ne_lng - sw_lng) * degrees_to_meters_lat(ne_lat - sw_lat) / 1e6


def bbox_dimensions_m(sw_lng: Column, sw_lat: Column, ne_lng: Column, ne_lat: Column) -> tuple[Column, Column]:
    return degrees_to_meters_lng((sw_lat + ne_lat) / 2, ne_lng - sw_lng), degrees_to_meters_lat(ne_lat - sw_lat)


def extent_degrees(lat: float, width_m: float, height_m: float) -> tuple[float, float]:
    """Half extents (lat, lng) of a box in metres."""
    c = math.cos(math.radians(lat))
    if abs(c) < 1e-10:
        raise ValueError("no longitude at the poles")
    return height_m / 2 / Z.M_PER_DEG_LAT, width_m / 2 / (Z.M_PER_DEG_LNG * c)


def cells_estimate(area_km2: float, resolution: int) -> int:
    if not 0 <= resolution <= 15:
        raise ValueError(f"resolution {resolution} is outside 0..15")
    return max(1, round(area_km2 / Z.CELL_AREA_KM2[resolution]))


def edge_length_m(resolution: int) -> float:
    if not 0 <= resolution <= 15:
        raise ValueError(f"resolution {resolution} is outside 0..15")
    return Z.CELL_EDGE_M[resolution]


def geodesic_m(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """Distance on the WGS 84 ellipsoid by Vincenty's inverse formula."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = math.atan((1 - f) * math.tan(math.radians(lat1))), math.atan((1 - f) * math.tan(math.radians(lat2)))
    span = lam = math.radians(lng2 - lng1)
    for _ in range(200):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(s, c)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        cos2 = 1 - sin_a**2
        mid = c - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        old, lam = lam, span + (1 - k) * f * sin_a * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
        if abs(lam - old) < 1e-12:
            break
    v = cos2 * (a * a - b * b) / (b * b)
    big = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
    small = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
    turn = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s * s - 3) * (4 * mid**2 - 3)))
    return b * big * (sigma - turn)


def growth_ratio(lat1: float, lat2: float, offset: float = 0.01) -> float:
    """How much longer a step of longitude is at lat1 than at lat2."""
    return geodesic_m(lat1, 0.0, lat1, offset) / geodesic_m(lat2, 0.0, lat2, offset)


WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def _vincenty(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Distances in metres by Vincenty's inverse formula, and whether each row came to rest. Rows that have are left out of later rounds."""
    f = WGS84_F
    b = WGS84_A * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(v))) for v in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    span = np.radians((lng2 - lng1 + 180) % 360 - 180)
    lam, rest = span.copy(), np.zeros(len(span), bool)
    s, c, sigma, cos2, mid = (np.zeros(len(span)) for _ in range(5))
    todo = np.arange(len(span))
    for _ in range(rounds):
        if not len(todo):
            break
        k = todo
        x, y = np.sin(lam[k]), np.cos(lam[k])
        s[k] = np.hypot(c2[k] * x, c1[k] * s2[k] - s1[k] * c2[k] * y)
        c[k] = s1[k] * s2[k] + c1[k] * c2[k] * y
        sigma[k] = np.arctan2(s[k], c[k])
        one = np.where(s[k] == 0, 0.0, c1[k] * c2[k] * x / np.where(s[k] == 0, 1.0, s[k]))
        cos2[k] = 1 - one**2
        mid[k] = np.where(cos2[k] == 0, 0.0, c[k] - 2 * s1[k] * s2[k] / np.where(cos2[k] == 0, 1.0, cos2[k]))
        g = f / 16 * cos2[k] * (4 + f * (4 - 3 * cos2[k]))
        new = span[k] + (1 - g) * f * one * (sigma[k] + g * s[k] * (mid[k] + g * c[k] * (2 * mid[k] ** 2 - 1)))
        still = np.abs(new - lam[k]) < 1e-14
        lam[k] = new
        wild = np.abs(new) > math.pi  # beyond the antipode the series has no answer
        rest[k[still & ~wild]] = True
        todo = k[~still & ~wild]
    v = cos2 * (WGS84_A**2 - b * b) / (b * b)
    big = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
    small = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
    turn = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s * s - 3) * (4 * mid**2 - 3)))
    return b * big * (sigma - turn), rest


def _waypoint(lat: np.ndarray, lng: np.ndarray, bearing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point a quarter of the sphere away."""
    y = np.arcsin(np.clip(np.cos(np.radians(lat)) * np.cos(bearing), -1, 1))
    x = np.radians(lng) + np.arctan2(np.sin(bearing) * np.cos(np.radians(lat)), -np.sin(np.radians(lat)) * np.sin(y))
    return np.degrees(y), (np.degrees(x) + 180) % 360 - 180


def geodesics(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """Distances in metres on the WGS 84 ellipsoid for arrays of points in degrees.

    Where the iteration doesn't come to rest, near the antipode, the way is cut in two: any way crosses the circle a quarter
    of the sphere from the first point, so the distance is the least sum over that circle, found by bearing.
    """
    out, rest = _vincenty(lat1, lng1, lat2, lng2)
    k = np.flatnonzero(~rest)
    if len(k):
        a, b, c, d = (v[k] for v in (lat1, lng1, lat2, lng2))

        def over(bearing: np.ndarray) -> np.ndarray:
            y, x = _waypoint(a, b, bearing)
            return _vincenty(a, b, y, x)[0] + _vincenty(y, x, c, d)[0]

        tries = np.stack([over(np.full(len(k), t)) for t in np.arange(0, 2 * math.pi, math.pi / 90)])
        best, width, golden = tries.argmin(axis=0) * math.pi / 90, math.pi / 90, (math.sqrt(5) - 1) / 2
        lo, hi = best - width, best + width
        for _ in range(40):
            p, q = hi - golden * (hi - lo), lo + golden * (hi - lo)
            left = over(p) < over(q)
            lo, hi = np.where(left, lo, p), np.where(left, q, hi)
        out[k] = over((lo + hi) / 2)
    return out


def _by_batch(f, n: int):  # noqa: ANN001, ANN202
    """An Arrow function of n columns of doubles; null where any is null or not finite."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            v = [np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in columns]
            good = np.isfinite(np.stack(v)).all(axis=0)
            yield pa.array(f(*[np.where(good, c, 0.0) for c in v]), mask=~good)

    return F.arrow_udf(run, T.DoubleType())


def geodesic(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between points on the WGS 84 ellipsoid, as a column."""
    return _by_batch(geodesics, 4)(*[c.cast("double") for c in (lat1, lng1, lat2, lng2)])


def growth(lat1: Column, lat2: Column, offset: float = 0.01) -> Column:
    """How much longer a step of longitude is at lat1 than at lat2, as a column."""

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        zero, step = np.zeros(len(a)), np.full(len(a), offset)
        with np.errstate(divide="ignore", invalid="ignore"):
            return geodesics(a, zero, a, step) / geodesics(b, zero, b, step)

    return _by_batch(ratio, 2)(lat1.cast("double"), lat2.cast("double"))
