"""Geodesics by whole columns against the scalar formula, and near the antipode against known distances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithotile.functions import geo


def test_geodesics_equal_the_scalar():
    rng = np.random.default_rng(1)
    lat1, lat2 = rng.uniform(-90, 90, (2, 10_000))
    lng1, lng2 = rng.uniform(-180, 180, (2, 10_000))
    lat2[:300], lng2[:300] = lat1[:300], lng1[:300]
    lat2[300:600], lng2[300:600] = lat1[300:600] + 1e-7, lng1[300:600]
    lat1[600:700], lat2[600:700] = 0.0, 0.0
    got = geo.geodesics(lat1, lng1, lat2, lng2)
    away = np.array([abs(a + c) < 2 and abs(abs((d - b) % 360) - 180) < 2 for a, b, c, d in zip(lat1, lng1, lat2, lng2, strict=True)])
    want = np.array([geo.geodesic_m(a, b, c, b + (d - b + 180) % 360 - 180) for a, b, c, d in zip(lat1, lng1, lat2, lng2, strict=True)])
    near = ~away & (np.abs(lat1) < 89.9) & (np.abs(lat2) < 89.9)
    assert near.sum() > 9000 and np.abs(got - want)[near].max() < 1e-3


def test_geodesics_near_the_antipode():
    """Known distances: from pole to pole, between antipodes of the equator (over a pole), and a published pair that the iteration misses."""
    half = 20003931.4586
    got = geo.geodesics(np.array([90.0, 0.0, 0.0, 30.0, 0.0]), np.zeros(5), np.array([-90.0, 0.0, 0.5, -30.0, 0.0]), np.array([0.0, 180.0, 179.7, 180.0, 179.0]))
    assert got[:2] == pytest.approx([half, half], abs=1e-3)
    assert got[2] == pytest.approx(19944127.421, abs=1e-2) and got[3] == pytest.approx(half, abs=1e-3) and got[4] < math.pi * geo.WGS84_A * 179 / 180


def test_columns(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0), (float("nan"), 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.geodesic(*[F.col(c) for c in "abcd"])).collect()]
    assert got[0] == pytest.approx(111319.4908, abs=1e-3) and got[1:] == [None, None]
    assert df.select(geo.growth(F.lit(0), F.lit(60))).first()[0] == pytest.approx(geo.growth_ratio(0, 60), rel=1e-9)


def test_degrees_at_the_poles(spark):
    df = spark.createDataFrame([(90.0,), (None,), (0.0,)], "lat double")
    assert [r[0] for r in df.select(geo.meters_to_degrees_lng(F.col("lat"), F.lit(111320.0))).collect()] == [None, None, 1.0]
    assert df.filter("lat is null or lat = 0").select(geo.meters_to_degrees_lng(F.col("lat"), F.lit(111320.0), strict=True).alias("d")).agg(F.sum("d")).first()[0] == 1.0
    with pytest.raises(Exception, match="no longitude at the poles"):
        df.select(geo.meters_to_degrees_lng(F.col("lat"), F.lit(1.0), strict=True)).collect()
    assert df.select(geo.meters_to_degrees_lat(F.lit(110574.0)), geo.latitude_scale_factor(F.lit(60.0))).first() == (1.0, pytest.approx(0.5))
