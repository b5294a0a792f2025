"""Closed-form checks of the geometry column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from regionlens.functions import geo


def _poly(spark, rings):
    schema = f"rings {geo.POLYGON_TYPE}"
    data = [([[{"x": float(x), "y": float(y)} for x, y in r] for r in rings],)]
    return spark.createDataFrame(data, schema)


SQUARE = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]
TRIANGLE = [[(0, 0), (6, 0), (0, 3), (0, 0)]]
L_SHAPE = [[(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3), (0, 0)]]
HOLE = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]]


@pytest.mark.parametrize("rings,area,cx,cy,perim", [
    (SQUARE, 100.0, 5.0, 5.0, 40.0),
    (TRIANGLE, 9.0, 2.0, 1.0, 9.0 + math.hypot(6, 3)),
    (L_SHAPE, 6.0, (4 * 2.0 + 2 * 0.5) / 6.0, (4 * 0.5 + 2 * 2.0) / 6.0, 14.0),
    (HOLE, 96.0, (100 * 5 - 4 * 3) / 96.0, (100 * 5 - 4 * 3) / 96.0, 48.0),
])
def test_area_centroid_perimeter(spark, rings, area, cx, cy, perim):
    df = _poly(spark, rings)
    c = geo.polygon_centroid("rings")
    r = df.select(geo.polygon_area("rings").alias("a"), c.x.alias("x"), c.y.alias("y"),
                  geo.polygon_perimeter("rings").alias("p")).first()
    assert r.a == pytest.approx(area)
    assert r.x == pytest.approx(cx)
    assert r.y == pytest.approx(cy)
    assert r.p == pytest.approx(perim)


@pytest.mark.parametrize("x,y,inside", [
    (5, 5, True), (3, 3, False), (0, 5, True), (10, 5, False), (5, 0, True), (5, 10, False),
    (1, 1, True), (2, 3, False), (4, 3, True), (11, 1, False),
])
def test_point_in_polygon_with_hole_half_open(spark, x, y, inside):
    df = _poly(spark, HOLE).select(geo.polygon_edges("rings").alias("e"))
    got = df.select(geo.point_in_edges("e", float(x), float(y)).alias("v")).first().v
    assert got is inside


def test_clip_length_tiling_adds_up(spark):
    # two squares sharing the edge x = 10; a segment crossing both and one
    # lying on the shared edge: pieces add up to the full lengths exactly once
    left = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]
    right = [[(10, 0), (20, 0), (20, 10), (10, 10), (10, 0)]]
    total = 0.0
    for rings in (left, right):
        e = _poly(spark, rings).select(geo.polygon_edges("rings").alias("e"))
        r = e.select(geo.clipped_segment_length(-5.0, 5.0, 25.0, 5.0, "e").alias("a"),
                     geo.clipped_segment_length(10.0, 2.0, 10.0, 8.0, "e").alias("b"),
                     geo.clipped_segment_length(2.0, 2.0, 8.0, 8.0, "e").alias("c")
                     ).first()
        total += r.a + r.b
        if rings is left:
            assert r.c == pytest.approx(math.hypot(6, 6))
        else:
            assert r.c == 0.0
    assert total == pytest.approx(20.0 + 6.0)


def _snyder_utm(lon, lat, zone):
    """Independent check: Snyder's (USGS, 1987) transverse Mercator series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = math.radians(lat), math.radians(lon)
    lam0 = math.radians(zone * 6 - 183)
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t = math.tan(phi) ** 2
    c = ep2 * math.cos(phi) ** 2
    aa = math.cos(phi) * (lam - lam0)
    m = a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi
             - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * math.sin(2 * phi)
             + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * math.sin(4 * phi)
             - (35 * e2 ** 3 / 3072) * math.sin(6 * phi))
    x = k0 * n * (aa + (1 - t + c) * aa ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * aa ** 5 / 120)
    y = k0 * (m + n * math.tan(phi) * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * aa ** 4 / 24
                                        + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * aa ** 6 / 720))
    return 500000.0 + x, y


@pytest.mark.parametrize("lon,lat", [(-81.0, 37.0), (-80.0, 38.0), (-83.5, 36.2), (-78.2, 39.9)])
def test_utm_against_independent_series(spark, lon, lat):
    r = spark.range(1).select(geo.to_utm(F.lit(lon), F.lit(lat), 17).alias("u")).first().u
    x, y = _snyder_utm(lon, lat, 17)
    assert r.x == pytest.approx(x, abs=0.01)
    assert r.y == pytest.approx(y, abs=0.01)
    if lon == -81.0:
        assert r.x == pytest.approx(500000.0, abs=1e-6)


def test_validity_and_repair(spark):
    bad = [[(0, 0), (0, 0), (5, 0), (5, 5), (0, 5)], [(1, 1), (2, 1), (1, 1)]]
    df = _poly(spark, bad).withColumn("fixed", geo.repair_rings("rings"))
    r = df.select(geo.is_valid("rings").alias("v0"), geo.is_valid("fixed").alias("v1"),
                  F.size("fixed").alias("n")).first()
    assert r.v0 is False and r.v1 is True and r.n == 1


def test_spectral_indices_zero_denominator(spark):
    r = spark.range(1).select(geo.ndvi(F.lit(0.0), F.lit(0.0)).alias("a"),
                              geo.ndvi(F.lit(3.0), F.lit(1.0)).alias("b")).first()
    assert r.a is None and r.b == pytest.approx(0.5)


def test_bilinear_weights_2x2(spark):
    from regionlens.operators import raster
    g = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "row int, col int, value double")
    w = raster.bilinear_warp(g, 2.0, 2.0).collect()
    assert len(w) == 1 and w[0].value == pytest.approx(2.5)
