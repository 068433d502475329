import math
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lithotile.functions import geo, wkb, zoom
from lithotile.operators import exporters, viewport
from lithotile.sources import registry


def test_tile_anchor():
    assert geo.tile_of(36.8219, -1.2921, 10) == (616, 515)


@given(st.floats(-179.9, 179.9), st.floats(-84, 84))
def test_cells_nest(lng, lat):
    x, y = geo.tile_of(lng, lat, 14)
    x2, y2 = geo.tile_of(lng, lat, 16)
    assert (x2 >> 2, y2 >> 2) == (x, y)


def test_zoom_functions():
    assert [zoom.resolution_for_zoom(z) for z in (0, 10, 11, 13, 15, 25)] == [7, 7, 8, 9, 10, 10]
    assert [zoom.feature_limit(z) for z in (None, 9, 12, 13)] == [5000, 500, 2000, 5000]
    assert [zoom.importance_threshold(z) for z in (None, 9, 12, 13)] == [0, 80, 40, 0]
    assert round(zoom.m_per_px(12), 4) == 38.2184
    assert zoom.describe(12)["ground_resolution_corrected_m"] == 144447.644
    assert zoom.semantic_level(21) == "street" and zoom.zooms_for_resolution(9) == (13, 14)
    assert zoom.parse_zoom_table("1 : 2.5\n") == {1: 2.5}
    with pytest.raises(ValueError):
        zoom.parse_zoom_table("")
    with pytest.raises(ValueError):
        zoom.describe(21)


def point(x, y):
    return struct.pack("<BIdd", 1, 1, x, y)


def polygon(*rings, order="<"):
    return struct.pack(order + "BII", order == "<", 3, len(rings)) + b"".join(struct.pack(f"{order}I{2 * len(r)}d", len(r), *[v for p in r for v in p]) for r in rings)


SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
HOLE = [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5), (0.5, 0.5)]


def test_wkb():
    assert point(1, 2).hex().upper() == "0101000000000000000000F03F0000000000000040"
    assert wkb.to_wkt(wkb.parse(point(1, 2))) == "POINT (1 2)"
    for order in "<>":
        g = wkb.parse(polygon(SQUARE, HOLE, order=order))
        assert wkb.centroid(g) == (1.0, 1.0) and wkb.to_geojson(g)["type"] == "Polygon"
    assert wkb.meets_box(g, (-1, -1, 0.1, 0.1)) and not wkb.meets_box(g, (0.8, 0.8, 1.2, 1.2)) and wkb.meets_box(g, (0.1, 0.1, 0.2, 0.2))
    ewkb = struct.pack("<BIIdd", 1, 0x20000001, 4326, 3, 4)
    assert wkb.centroid(wkb.parse(ewkb)) == (3, 4)
    with pytest.raises(ValueError):
        wkb.parse(b"\x01\x03\x00")
    assert wkb.geojson_to_wkt("{") == "POINT EMPTY"


def test_utm_area():
    d = 0.001
    a, p = wkb.area_perimeter(("Polygon", [[(39, 0), (39 + d, 0), (39 + d, d), (39, d), (39, 0)]]), 32637)
    east, north = geo.geodesic_m(0, 39, 0, 39 + d), geo.geodesic_m(0, 39, d, 39)
    assert a == pytest.approx(east * north * 0.9996**2, rel=1e-6) and p == pytest.approx(2 * (east + north) * 0.9996, rel=1e-6)


def test_distances():
    assert geo.geodesic_m(0, 0, 0, 1) == pytest.approx(111319.49, abs=0.01)
    assert geo.growth_ratio(0, 60) == pytest.approx(2, rel=0.01) and geo.cells_estimate(10.5, 9) == 100
    assert math.isclose(geo.extent_degrees(0, 222640, 221148)[0], 1)


def test_registries_and_towns():
    assert len(registry.TOWNS) == 53 and registry.slug("Murang'a") == "murang-a" and "homa-bay" in registry.TOWNS
    assert registry.TOWNS.get("nairobi").lat == -1.2921 and not registry.register_town("nairobi", registry.TOWNS.get("prague"))
    with pytest.raises(ValueError):
        registry.register_town("nairobi", registry.TOWNS.get("prague"), "raise")
    with pytest.raises(ValueError):
        registry.DATASETS.get("nowhere")
    with pytest.raises(ValueError):
        registry.TOWNS.get("prague").bbox_params()
    assert registry.view_name("kenya-buildings") == "kenya_buildings_view" and exporters.pascal_case("ol kalou") == "OlKalou"


def test_validators():
    for bad in ((1, 1, 0, 2), (0, 0, 11, 1), (0, 0, 200, 1)):
        with pytest.raises(viewport.QueryError):
            viewport.check_box(bad)
    with pytest.raises(viewport.QueryError) as e:
        viewport.check_gate(10, registry.BUILDINGS.get("kenya-buildings"))
    assert e.value.envelope()["error"]["code"] == "ZOOM_GATE"
    for f, v in ((viewport.check_limit, 0), (viewport.check_cell, "xyz"), (viewport.check_zoom, 21)):
        with pytest.raises(viewport.QueryError):
            f(v)
