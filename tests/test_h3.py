"""The grid's cells against published ones, round trips over the whole sphere, and polygons against brute force over centres."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithotile.functions import geo, h3

#: Published cells of points (lat, lng).
KNOWN = {
    (37.775938728915946, -122.41795063018799): "8928308280fffff", (40.689167, -74.044444): "8a2a1072b59ffff", (37.769377, -122.388903): "89283082e73ffff",
    (0.0, 0.0): "8a754e64992ffff", (37.3615593, -122.0553238): "87283472bffffff",
}
#: Published centres of cells.
CENTRES = {"8928308280fffff": (37.77670234943567, -122.41845932318311), "85283473fffffff": (37.34579337536848, -121.97637597255124), "8001fffffffffff": (79.24239850975904, 38.02340700796989)}
PENTAGONS = "8009fffffffffff 801dfffffffffff 8031fffffffffff 804dfffffffffff 8063fffffffffff 8075fffffffffff 807ffffffffffff 8091fffffffffff 80a7fffffffffff 80c3fffffffffff 80d7fffffffffff 80ebfffffffffff"


def test_published_cells():
    for (lat, lng), cell in KNOWN.items():
        assert h3.to_hex(h3.latlng_to_cells([lat], [lng], (int(cell[1], 16),))[0]) == [cell] and h3.is_cell(cell)
    for cell, at in CENTRES.items():
        lat, lng = h3.cells_to_latlng([h3.from_hex(cell)], int(cell[1], 16))
        assert (lat[0], lng[0]) == pytest.approx(at, abs=1e-9)
    g = h3.grid()
    assert h3.to_hex(h3.base_cells()[g.pentagon]) == PENTAGONS.split()
    assert (np.diff(g.latitude) < 1e-9).all()  # base cells are numbered from north to south


def sphere(n, seed=0):
    """Points of the whole sphere, of the poles, and close to pentagons and face edges."""
    rng, g = np.random.default_rng(seed), h3.grid()
    p = rng.normal(size=(n, 3))
    corners = g.point(g.home_face[g.pentagon], g.home[g.pentagon])
    near = [corners[rng.integers(0, 12, n)] + rng.normal(0, s, (n, 3)) for s in (0.3, 0.01, 1e-4)]
    edge = [a + t * (b - a) for a in corners for b in corners if 0.1 < np.linalg.norm(a - b) < 1.2 for t in rng.uniform(0, 1, (5, 1))]
    p = np.concatenate([p, *near, edge, [[0, 0, 1], [0, 0, -1], [-1, 0, 0], [-1, 1e-9, 0], [-1, -1e-9, 0]]])
    p /= np.linalg.norm(p, axis=1)[:, None]
    return np.degrees(np.arcsin(p[:, 2])), np.degrees(np.arctan2(p[:, 1], p[:, 0]))


@pytest.mark.parametrize("res", range(16))
def test_centres_lie_in_their_cells(res):
    lat, lng = sphere(4000, res)
    (cells,) = h3.latlng_to_cells(lat, lng, (res,))
    back = h3.cells_to_latlng(cells, res)
    assert (h3.latlng_to_cells(*back, (res,))[0] == cells).all()
    away = np.linalg.norm(h3._xyz(*np.radians(back)) - h3._xyz(np.radians(lat), np.radians(lng)), axis=1)
    assert away.max() < 0.58 * np.radians(h3.spacing_degrees(res))  # no point is nearer to a far cell
    assert all(map(h3.is_cell, h3.to_hex(cells[:300])))


def test_every_cell_is_met_once():
    for res in range(4):
        cells = every(res)
        assert len(set(cells.tolist())) == 2 + 120 * 7**res
        lat, lng = h3.cells_to_latlng(cells, res)
        assert (h3.latlng_to_cells(lat, lng, (res,))[0] == cells).all()


def every(res):
    cells = h3.base_cells()
    for r in range(res):
        cells, _ = h3.children(cells, r)
    return cells


POLYGONS = [
    [[(10, 10), (40, 5), (50, 40), (20, 45)], [(25, 15), (35, 15), (35, 30), (25, 30)]],  # a hole
    [[(170, -20), (-170, -20), (-160, 30), (165, 25)]],  # across the antimeridian
    [[(-60, 60), (0, 62), (60, 60), (119, 65), (110, 88)]],
    [[(-10, -10), (10, -10), (0, 15)], [(30, -5), (60, -5), (45, 20)]],  # two parts
    [[(0, 0), (0.001, 0), (0, 0.001)]],
    [[(1, 1), (1, 1)]],
]


@pytest.mark.parametrize("rings", POLYGONS)
def test_polygon_equals_brute_force(spark, rings):
    area = h3.Area(rings)
    for res in (0, 1, 4):
        cells = every(res)
        want = set(h3.to_hex(cells[area.holds(*h3.cells_to_latlng(cells, res))])) if area.box else set()
        for most in (4096, 300):
            got = [r.cell for r in h3.cells_in_polygon(spark, rings, res, most).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    assert h3.cells_in_polygon(spark, [], 5).count() == 0


def test_cells_of_rows(spark):
    rows = [(37.775938728915946, -122.41795063018799), (None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("inf")), (90.0, 0.0), (-90.0, 180.0)]
    got = spark.createDataFrame(rows, "lat double, lng double").select(h3.cell_hex(F.col("lat"), F.col("lng"), 9).alias("c"), geo.cell_to_long(h3.cell_hex(F.col("lat"), F.col("lng"), 9)).alias("n")).collect()
    assert got[0].c == "8928308280fffff" and got[0].n == h3.from_hex(got[0].c) and [r.c for r in got[1:5]] == [None] * 4 and all(h3.is_cell(r.c) for r in got[5:])


def test_cell_box_holds_its_points():
    lat, lng = sphere(300, 5)
    for res in (0, 3, 8):
        for y, x, c in zip(lat, lng, h3.to_hex(h3.latlng_to_cells(lat, lng, (res,))[0]), strict=True):
            box = h3.cell_box(c)
            assert box is None or (box[0] <= x <= box[2] and box[1] <= y <= box[3])


def test_what_is_no_cell():
    for bad in ("0", "8928308280ffffe", "8a2a1072b59fff8", "80f5fffffffffff", "81087ffffffffff"):
        assert not h3.is_cell(bad)
