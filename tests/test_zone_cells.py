"""Cell-clipped edges with a parity corner: against the plain even-odd test, and how large the table is."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlens.functions import geo
from regionlens.operators import spatial


def star(n, seed, shift=0.0):
    """A star-shaped polygon of n vertices around (50, 50) and a hole of n // 4."""
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    radius = 30 + 12 * np.sin(9 * angle) + rng.uniform(0, 1, n)
    shell = [{"x": float(50 + shift + r * math.cos(a)), "y": float(50 + r * math.sin(a))} for a, r in zip(angle, radius)]
    inner = [{"x": float(50 + shift + 5 * math.cos(a)), "y": float(50 + 5 * math.sin(a))} for a in angle[::4]]
    return [shell + shell[:1], inner + inner[:1]]


def even_odd(rings, x, y):
    inside = np.zeros(len(x), bool)
    for ring in rings:
        for p, q in zip(ring, ring[1:]):
            ax, ay, bx, by = p["x"], p["y"], q["x"], q["y"]
            span = (ay > y) != (by > y)
            if span.any():
                inside ^= span & (x < ax + (y - ay) * (bx - ax) / (by - ay if by != ay else 1.0))
    return inside


@pytest.mark.parametrize("cell", [7.3, 25.0, 0.9])
def test_points_in_ragged_zones(spark, cell):
    rng = np.random.default_rng(1)
    zones = {"a": star(400, 2), "b": star(120, 3, 40.0)}
    xy = np.concatenate([rng.uniform(0, 140, (3000, 2)), cell * rng.integers(0, 15, (300, 2)), rng.integers(0, 140, (300, 2)).astype(float)])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    df = spark.createDataFrame(list(zones.items()), f"zone string, rings {geo.POLYGON_TYPE}")
    got = {(r.zone, r.id) for r in spatial.assign_points_to_zones(points, df, ["zone"], cell).collect()}
    want = {(z, int(i)) for z, rings in zones.items() for i in np.flatnonzero(even_odd(rings, xy[:, 0], xy[:, 1]))}
    assert got == want


@pytest.mark.parametrize("cell", [10.0, 3.7])
def test_borders_on_cell_borders(spark, cell):
    """Squares whose sides, and diamonds whose corners, lie on cell borders tile: every point has one zone."""
    step = 20.0 if cell == 10.0 else 4 * cell
    squares = [(f"{i},{j}", [[{"x": step * (i + u), "y": step * (j + v)} for u, v in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]])
               for i in range(3) for j in range(3)]
    half = step / 2
    diamond = [(f"d{i}", [[{"x": step * 1.5 + half * u, "y": step * 1.5 + half * v} for u, v in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))]])
               for i in range(1)]
    df = spark.createDataFrame(squares + diamond, f"zone string, rings {geo.POLYGON_TYPE}")
    grid = [(i, j, half / 2 * i, half / 2 * j) for i in range(12) for j in range(12)]
    points = spark.createDataFrame(grid, "i int, j int, x double, y double")
    rows = spatial.assign_points_to_zones(points, df, ["zone"], cell).collect()
    tiles = [(r.i, r.j) for r in rows if not r.zone.startswith("d")]
    assert len(tiles) == len(set(tiles)) == len(grid)
    in_diamond = {(r.i, r.j) for r in rows if r.zone.startswith("d")}
    want = {(i, j) for i, j, x, y in grid if even_odd(diamond[0][1], np.array([x]), np.array([y]))[0]}
    assert in_diamond == want


def test_table_grows_with_edges(spark):
    n = 10_000
    df = spark.createDataFrame([("a", star(n, 5))], f"zone string, rings {geo.POLYGON_TYPE}")
    cells = spatial.zone_cells(df, 2.0).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.size("_edges")).alias("edges")).first()
    assert cells.edges < 3 * (n + n // 4 + 1) and cells.cells < 2500
    rng = np.random.default_rng(7)
    xy = rng.uniform(0, 100, (500, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    got = {r.id for r in spatial.assign_points_to_zones(points, df, ["zone"], 2.0).collect()}
    assert got == set(np.flatnonzero(even_odd(star(n, 5), xy[:, 0], xy[:, 1])).tolist())


def test_lengths_do_not_depend_on_cells(spark):
    rng = np.random.default_rng(8)
    a, b = rng.uniform(0, 140, (80, 2)), rng.uniform(0, 140, (80, 2))
    b[:10, 0], a[:10, 0], a[10:20, 1], b[10:20, 1] = 50.0, 50.0, 40.0, 40.0    # along cell borders of width 10
    segs = spark.createDataFrame([(i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(a, b))],
                                 "id int, ax double, ay double, bx double, by double")
    df = spark.createDataFrame([("a", star(200, 9)), ("b", star(60, 10, 40.0))], f"zone string, rings {geo.POLYGON_TYPE}")
    got = []
    for cell in (10.0, 33.3, 500.0):
        pieces = spatial.clip_segments_to_zones(segs, df, ["zone"], cell, ["id"])
        got.append({(r.id, r.zone): r.l for r in pieces.groupBy("id", "zone").agg(F.sum("length").alias("l")).where("l > 1e-9").collect()})
    plain = segs.crossJoin(df.withColumn("e", geo.polygon_edges("rings"))).select(
        "id", "zone", geo.clipped_segment_length("ax", "ay", "bx", "by", "e").alias("l")).where("l > 1e-9").collect()
    want = {(r.id, r.zone): r.l for r in plain}
    for g in got:
        assert g == pytest.approx(want, rel=1e-9, abs=1e-9)
