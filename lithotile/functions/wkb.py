"""Geometry from WKB and EWKB: centroid, envelope, metric area and perimeter by whole batches (wkb_batch), WKT and GeoJSON text by row."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wkb_batch

KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
Geometry = tuple  # (kind, coordinates or parts)


def parse(data: bytes) -> Geometry:
    """(kind, body): nested lists of (x, y), or geometries for a collection. Raises ValueError on malformed input."""
    try:
        g, end = _read(memoryview(data), 0)
    except (struct.error, IndexError) as e:
        raise ValueError("malformed WKB") from e
    return g


def _read(b: memoryview, at: int) -> tuple[Geometry, int]:
    order = "<" if b[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    if code & 0x20000000:  # EWKB: an SRID follows
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    dims = max(dims, {0: 2, 1: 3, 2: 3, 3: 4}.get(code // 1000, 2))
    kind = KINDS.get(code % 1000)
    if kind is None:
        raise ValueError(f"geometry type {code}")

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", b, at)
        at += 4
        if n > len(b):
            raise ValueError("malformed WKB")
        return n

    def points(n: int) -> list[tuple[float, float]]:
        nonlocal at
        v = struct.unpack_from(f"{order}{n * dims}d", b, at)
        at += 8 * n * dims
        return [(v[i * dims], v[i * dims + 1]) for i in range(n)]

    if kind == "Point":
        p = points(1)[0]
        return (kind, None if math.isnan(p[0]) else p), at
    if kind == "LineString":
        return (kind, points(count())), at
    if kind == "Polygon":
        return (kind, [points(count()) for _ in range(count())]), at
    parts = []
    for _ in range(count()):
        g, at = _read(b, at)
        parts.append(g)
    return (kind, parts if kind == "GeometryCollection" else [p[1] for p in parts]), at


def simple_parts(g: Geometry) -> list[Geometry]:
    kind, body = g
    if kind == "GeometryCollection":
        return [s for p in body for s in simple_parts(p)]
    if kind.startswith("Multi"):
        return [(kind[5:], p) for p in body]
    return [g]


def vertices(g: Geometry) -> list[tuple[float, float]]:
    out = []
    for kind, body in simple_parts(g):
        out += [body] * (body is not None) if kind == "Point" else body if kind == "LineString" else [p for ring in body for p in ring]
    return out


def _ring(r: list) -> tuple[float, float, float]:
    """Signed area and first moments, taken about the first vertex."""
    if len(r) < 3:
        return 0.0, 0.0, 0.0
    p = np.asarray(r, float)
    x, y = p[:, 0] - p[0, 0], p[:, 1] - p[0, 1]
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    c = x * y2 - x2 * y
    a = c.sum() / 2
    return a, ((x + x2) * c).sum() / 6 + a * p[0, 0], ((y + y2) * c).sum() / 6 + a * p[0, 1]


def centroid(g: Geometry) -> tuple[float, float] | None:
    """Weighted by area if there is any, else by length, else the mean of the points."""
    area = mx = my = 0.0
    for kind, body in simple_parts(g):
        if kind == "Polygon":
            for k, r in enumerate(body):
                a, x, y = _ring(r)
                s = (1.0 if k == 0 else -1.0) * (1.0 if a >= 0 else -1.0)  # holes count against, whatever their turn
                area, mx, my = area + s * a, mx + s * x, my + s * y
    if area:
        return mx / area, my / area
    total = mx = my = 0.0
    for kind, body in simple_parts(g):
        for line in [body] if kind == "LineString" else body if kind == "Polygon" else []:
            for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
                d = math.hypot(x1 - x0, y1 - y0)
                total, mx, my = total + d, mx + d * (x0 + x1) / 2, my + d * (y0 + y1) / 2
    if total:
        return mx / total, my / total
    p = vertices(g)
    return (sum(x for x, _ in p) / len(p), sum(y for _, y in p) / len(p)) if p else None


def utm(lng: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Transverse Mercator of a UTM zone by the Krueger series, in metres. x is always longitude."""
    zone, south = epsg % 100, epsg // 100 == 327
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = np.radians(lat), np.radians(lng - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x = eta + sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))
    y = xi + sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(alpha, 1))
    return 500000 + 0.9996 * big * x, (10_000_000 if south else 0) + 0.9996 * big * y


def area_perimeter(g: Geometry, epsg: int) -> tuple[float, float]:
    area = around = 0.0
    for kind, body in simple_parts(g):
        for k, r in enumerate(body if kind == "Polygon" else []):
            if not r:
                continue
            p = np.asarray(r, float)
            x, y = utm(p[:, 0], p[:, 1], epsg)
            a = abs(_ring(list(zip(x, y, strict=True)))[0])
            area += a if k == 0 else -a
            around += float(np.hypot(np.diff(x), np.diff(y)).sum())
    return area, around


def to_geojson(g: Geometry) -> dict:
    kind, body = g
    if kind == "GeometryCollection":
        return {"type": kind, "geometries": [to_geojson(p) for p in body]}
    return {"type": kind, "coordinates": body if body is not None else []}


def to_wkt(g: Geometry) -> str:
    kind, body = g
    if not body:
        return f"{kind.upper()} EMPTY"
    num = lambda v: str(int(v)) if float(v).is_integer() else repr(float(v))
    pt = lambda p: f"{num(p[0])} {num(p[1])}"

    def inner(x: list, depth: int) -> str:
        return "(" + ", ".join(pt(p) if depth == 0 else inner(p, depth - 1) for p in x) + ")"

    if kind == "GeometryCollection":
        return "GEOMETRYCOLLECTION (" + ", ".join(map(to_wkt, body)) + ")"
    if kind == "Point":
        return f"POINT ({pt(body)})"
    if kind == "MultiPoint":
        return "MULTIPOINT (" + ", ".join(f"({pt(p)})" for p in body) + ")"
    return f"{kind.upper()} {inner(body, {'LineString': 0, 'Polygon': 1, 'MultiLineString': 1, 'MultiPolygon': 2}[kind])}"


def from_geojson(j: dict) -> Geometry:
    if j["type"] == "GeometryCollection":
        return j["type"], [from_geojson(x) for x in j["geometries"]]
    return j["type"], j["coordinates"]


def geojson_to_wkt(text: str | None) -> str:
    """WKT of a GeoJSON geometry; POINT EMPTY for what cannot be read."""
    try:
        return to_wkt(from_geojson(json.loads(text)))
    except (TypeError, KeyError, ValueError, IndexError):
        return "POINT EMPTY"


def meets_box(g: Geometry, box: tuple[float, float, float, float]) -> bool:
    """Whether any part of the geometry lies in the box: a vertex, an edge across it, or the box inside a polygon."""
    x0, y0, x1, y1 = box
    inside = lambda p: x0 <= p[0] <= x1 and y0 <= p[1] <= y1
    if any(map(inside, vertices(g))):
        return True

    def cut(p: tuple, q: tuple) -> bool:
        lo, hi, d = 0.0, 1.0, (q[0] - p[0], q[1] - p[1])
        for k, (a, b) in enumerate(((x0, x1), (y0, y1))):
            if d[k] == 0:
                if not a <= p[k] <= b:
                    return False
                continue
            s, t = sorted(((a - p[k]) / d[k], (b - p[k]) / d[k]))
            lo, hi = max(lo, s), min(hi, t)
        return lo <= hi

    def holds(ring: list, p: tuple) -> bool:
        odd = False
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                odd = not odd
        return odd

    for kind, body in simple_parts(g):
        for line in [body] if kind == "LineString" else body if kind == "Polygon" else []:
            if any(cut(p, q) for p, q in zip(line, line[1:], strict=False)):
                return True
        if kind == "Polygon" and body and sum(holds(r, (x0, y0)) for r in body) % 2:
            return True
    return False


SHAPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("lng", "lat", "xmin", "ymin", "xmax", "ymax", "area_m2", "perimeter_m")])


def shape_udf(epsg: int | None = None):  # noqa: ANN201
    """struct<lng,lat,xmin,ymin,xmax,ymax,area_m2,perimeter_m> of a WKB column, by whole batches; malformed or null WKB gives nulls."""

    def shape(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = wkb_batch.shapes(column, epsg)
            yield pa.StructArray.from_arrays([pa.array(found[n], mask=np.isnan(found[n])) for n in SHAPE.names], names=SHAPE.names)

    return F.arrow_udf(shape, SHAPE)


@F.pandas_udf(T.StringType())
def wkb_to_geojson(wkb: pd.Series) -> pd.Series:
    from lithotile.functions import wkb as own

    def one(data: bytes | None) -> str | None:
        try:
            return json.dumps(own.to_geojson(own.parse(bytes(data)))) if data is not None else None
        except ValueError:
            return None

    return wkb.map(one)


@F.pandas_udf(T.StringType())
def geojson_wkt(text: pd.Series) -> pd.Series:
    from lithotile.functions import wkb as own

    return text.map(own.geojson_to_wkt)


def meets_box_udf(box: tuple[float, float, float, float]):  # noqa: ANN201
    def meets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(wkb_batch.meets(column, box))

    return F.arrow_udf(meets, T.BooleanType())


def box_to_wkb(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Little-endian WKB of boxes: a polygon of one closed ring, or a point where the box has no extent."""

    def encode(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield wkb_batch.boxes(*(np.asarray(c.cast(pa.float64())) for c in columns))

    return F.arrow_udf(encode, T.BinaryType())(xmin, ymin, xmax, ymax)
