"""Quadtree searches on clustered and odd points, against brute force, and how much they look at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlens.operators import quadtree, spatial

FAC = "facility_id long, x double, y double, amenity string"
PTS = "id string, x double, y double"


def clustered(seed, n, m):
    """m facilities, most in a few dense clusters, some copies and some on a grid; n points among them."""
    rng = np.random.default_rng(seed)
    centre = rng.uniform(0, 50_000, (4, 2))
    fac = np.concatenate([centre[rng.integers(0, 4, m)] + rng.normal(0, 40, (m, 2)), rng.uniform(0, 50_000, (20, 2)),
                          1000.0 * rng.integers(0, 50, (20, 2))])
    fac = np.concatenate([fac, fac[:15]])
    pts = np.concatenate([centre[rng.integers(0, 4, n)] + rng.normal(0, 3000, (n, 2)), 1000.0 * rng.integers(0, 50, (10, 2))])
    return fac, pts


@pytest.mark.parametrize("seed", [0, 1])
def test_counts_and_nearest_on_clusters(spark, seed):
    fac, pts = clustered(seed, 60, 700)
    kind = np.arange(len(fac)) % 2
    df = spark.createDataFrame([(i, float(x), float(y), "school" if k else "bank") for i, ((x, y), k) in enumerate(zip(fac, kind))],
                               FAC).repartition(3)
    points = spark.createDataFrame([(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(pts)], PTS)
    radii = (1000, 2000, 5000)
    got = {r.id: r for r in spatial.count_within(points, df, "id", radii, ["school", "bank"]).collect()}
    near = {r.id: r for r in spatial.nearest_facility(points, df, "id", ["school", "bank"]).collect()}
    assert len(got) == len(near) == len(pts)
    for i, p in enumerate(pts):
        d2 = (p[0] - fac[:, 0]) ** 2 + (p[1] - fac[:, 1]) ** 2
        for name, k in (("school", 1), ("bank", 0)):
            for r in radii:
                assert got[f"p{i}"][f"{name}_count_{r // 1000}km"] == int(((d2 <= r * r) & (kind == k)).sum())
            own = np.where(kind == k, d2, np.inf)
            assert near[f"p{i}"][f"nearest_{name}_dist"] == pytest.approx(np.sqrt(own.min()))
            assert near[f"p{i}"][f"nearest_{name}_id"] == int(np.flatnonzero(own == own.min())[0])


def test_work_grows_with_the_rim(spark, monkeypatch):
    """Eight times the facilities in a cluster: the spots that are measured grow far less."""
    seen = []
    plain = quadtree.Tree.with_spots

    def spy(self, pairs, keep):
        out = plain(self, pairs, keep)
        seen.append(out.count())
        return out

    monkeypatch.setattr(quadtree.Tree, "with_spots", spy)
    rng = np.random.default_rng(4)
    work = []
    for m in (2000, 16_000):
        fac = rng.uniform(0, 10_000, (m, 2))
        df = spark.createDataFrame([(i, float(x), float(y), "school") for i, (x, y) in enumerate(fac)], FAC)
        points = spark.createDataFrame([(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(3000, 7000, (12, 2)))], PTS)
        seen.clear()
        got = spatial.count_within(points, df, "id", (3000,), ["school"])
        total = got.agg(F.sum("school_count_3km")).first()[0]
        nearest = spatial.nearest_facility(points, df, "id", ["school"])
        nearest.count()
        work.append((total, seen[0], seen[1]))
    (small, rim, close), (large, more_rim, more_close) = work
    assert large > 6 * small and more_rim < 4.5 * rim and more_rim < large / 4
    assert more_close < 2 * close + 40 and more_close <= 12 * 60


def test_odd_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "school"), (2, 0.0, 0.0, "school"), (3, float("nan"), 1.0, "school"),
                                (4, None, 1.0, "school"), (5, float("inf"), 0.0, "school"), (6, -3000.0, 4000.0, "school")], FAC)
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", None, 0.0), ("c", float("nan"), 0.0), ("d", 1e9, -1e9),
                                    ("e", 0.0, 5000.0)], PTS)
    got = {r.id: tuple(r)[1:] for r in spatial.count_within(points, df, "id", (1000, 5000), ["school"]).collect()}
    assert got == {"a": (2, 3), "b": (0, 0), "c": (0, 0), "d": (0, 0), "e": (0, 3)}
    near = {r.id: tuple(r)[1:] for r in spatial.nearest_facility(points, df, "id", ["school", "bank"]).collect()}
    assert near["a"] == (0.0, 1, None, None) and near["b"] == near["c"] == (None,) * 4
    assert near["d"][1] == 1 and near["e"][1] == 6
    one_place = spark.createDataFrame([(i, 7.0, 7.0, "school") for i in range(100)], FAC)
    assert spatial.nearest_facility(points, one_place, "id", ["school"]).where("id = 'a'").first().nearest_school_id == 0
