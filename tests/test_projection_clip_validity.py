"""Inverse projection, reference systems, clipped lines, reprojected rasters, polygon validity."""

import math

import pytest
from pyspark.sql import functions as F

from regionlens.functions import geo
from regionlens.operators import profile, raster, spatial, validity


@pytest.mark.parametrize("zone,north", [(1, True), (18, True), (31, False), (60, False)])
def test_utm_round_trip_under_a_millimetre(spark, zone, north):
    mid = zone * 6 - 183
    rows = [(mid + dx / 2, lat if north else -lat) for dx in range(-7, 8) for lat in (0.0, 0.3, 17.5, 45.0, 71.9, 83.0)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("u", geo.to_utm("lon", "lat", zone, north))
    df = df.withColumn("b", geo.from_utm("u.x", "u.y", zone, north)).withColumn("v", geo.to_utm("b.x", "b.y", zone, north))
    for r in df.collect():
        assert math.hypot(r.u.x - r.v.x, r.u.y - r.v.y) < 1e-3
        assert abs(r.b.x - r.lon) < 1e-8 / max(math.cos(math.radians(r.lat)), 0.1) and abs(r.b.y - r.lat) < 1e-8


def test_systems(spark):
    df = spark.createDataFrame([(1, 500000.0, 4.2e6, None), (2, 500000.0, 4.2e6, 32618), (3, -75.0, 38.0, 4326),
                                (4, 500000.0, 4.2e6, 2263), (5, None, 1.0, 4326), (6, 500000.0, 4.2e6, 32617),
                                (7, 500000.0, 1e7, 32718)], "id int, x double, y double, code int")
    got = {r.id: r.p for r in df.select("id", geo.to_crs("x", "y", F.col("code"), 32618).alias("p")).collect()}
    assert (got[1].x, got[1].y) == (got[2].x, got[2].y) == (500000.0, 4.2e6)
    assert got[3].x == pytest.approx(500000.0, abs=1e-3) and got[4] is None and got[5].x is None
    assert got[6].x < 0 and got[7].y == pytest.approx(0.0, abs=1e-3)
    back = df.where("id = 6").select(geo.to_crs("x", "y", F.col("code"), 4326).alias("p")).first().p
    assert back.x == pytest.approx(-81.0, abs=1e-9)
    codes = df.limit(1).select(geo.utm_code(F.lit(-75.0), F.lit(38.0)).alias("a"), geo.utm_code(F.lit(180.0), F.lit(-1.0)).alias("b")).first()
    assert (codes.a, codes.b) == (32618, 32701)
    with pytest.raises(ValueError):
        geo.to_crs("x", "y", F.col("code"), 2263)


def square(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def path(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_clipped_lines_merge_and_stitch(spark):
    zones = spark.createDataFrame([([square(0, 0, 10, 10)],), ([square(5, 0, 15, 10)],), ([square(20, 0, 30, 10), square(23, 2, 27, 8)],)],
                                  f"rings {geo.POLYGON_TYPE}")
    lines = spark.createDataFrame([(1, path((-5, 5), (35, 5))), (2, path((1, 1), (9, 1), (9, 9), (14, 9))),
                                   (3, path((-5, -5), (35, -5))), (4, path((2, 2), (2, 20), (4, 20), (4, 2))),
                                   (5, path((3, 3), (3, 3), (4, 3)))], "id int, line array<struct<x:double,y:double>>")
    got = {}
    for r in spatial.clip_lines(lines, zones, "id", 4.0).orderBy("id", "piece").collect():
        got.setdefault(r.id, []).append(([(round(p.x, 9), round(p.y, 9)) for p in r.line], round(r.length, 9)))
    assert got[1] == [([(0, 5), (15, 5)], 15.0), ([(20, 5), (23, 5)], 3.0), ([(27, 5), (30, 5)], 3.0)]
    assert got[2] == [([(1, 1), (9, 1), (9, 9), (14, 9)], 21.0)]
    assert 3 not in got
    assert got[4] == [([(2, 2), (2, 10)], 8.0), ([(4, 10), (4, 2)], 8.0)]
    assert got[5][0][1] == 1.0
    multi = spark.createDataFrame([(1, [path((1, 1), (3, 1)), path((3, 1), (4, 1))])], "id int, line array<array<struct<x:double,y:double>>>")
    pieces = spatial.clip_lines(multi, zones, "id", 4.0).orderBy("piece").collect()
    assert [r.length for r in pieces] == [2.0, 1.0]
    assert spatial.clip_lines(lines.where("false"), zones, "id", 4.0).count() == 0


def test_validity(spark):
    circle = path(*[(100 * math.cos(t * math.pi / 1000), 100 * math.sin(t * math.pi / 1000)) for t in range(2000)], (100, 0))
    shapes = {
        "square": [square(0, 0, 4, 4)], "circle": [circle],
        "bow": [path((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))],
        "hole": [square(0, 0, 9, 9), square(2, 2, 4, 4)],
        "touching hole": [square(0, 0, 9, 9), path((0, 4), (2, 3), (2, 5), (0, 4))],
        "crossing hole": [square(0, 0, 9, 9), square(7, 2, 12, 4)],
        "outer hole": [square(0, 0, 9, 9), square(20, 2, 24, 4)],
        "shared border": [square(0, 0, 9, 9), square(0, 2, 4, 4)],
        "spike": [path((0, 0), (4, 0), (8, 0), (4, 0), (4, 4), (0, 0))],
        "own touch": [path((0, 0), (8, 0), (4, 4), (8, 8), (0, 8), (4, 4), (0, 0))],
        "open": [path((0, 0), (4, 0), (4, 4))], "flat": [path((0, 0), (4, 0), (8, 0), (0, 0))], "none": None, "empty": [],
    }
    df = spark.createDataFrame([(k, v) for k, v in shapes.items()], f"name string, rings {geo.POLYGON_TYPE}")
    got = {r.name: (r["shape"], r.crossing, r.outside) for r in validity.invalid_parts(df, "name").collect()}
    assert len(got) == len(shapes)
    for good in ("square", "circle", "hole", "touching hole"):
        assert got[good] == (False, False, False), good
    for crossed in ("bow", "crossing hole", "shared border", "spike", "own touch"):
        assert got[crossed][1], crossed
    assert got["outer hole"] == (False, False, True) and got["open"][0] and got["flat"][0] and got["none"][0] and got["empty"][0]


def test_reprojected_constant_and_empty(spark):
    grid = spark.range(400).select((F.col("id") % 20).alias("col"), F.expr("id div 20").alias("row"), F.lit(7.0).alias("value"))
    out = raster.reproject(grid, 18, 100.0, -75.0, 0.001, 38.0, 0.001).collect()
    inside = [r for r in out if r.weight and r.weight > 0.999]
    assert len(inside) > 250 and all(abs(r.value - 7.0) < 1e-9 for r in inside)
    assert raster.reproject(grid.where("false"), 18, 100.0, -75.0, 0.001, 38.0, 0.001).count() == 0


def test_outlier_rows(spark):
    rows = [("a", float(v), i) for i, v in enumerate([1, 2, 3, 4, 100, -50])] + [("b", 5.0, 9), (None, 1e9, 10), ("a", None, 11)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    assert {r.id for r in profile.boxplot_outliers(df, "g", "v").collect()} == {4, 5}
