"""Counts in discs meet spots by blocks of points, not point by point."""

import numpy as np

from regionlens.operators import quadtree, spatial


def test_points_meet_leaves_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(quadtree, "BLOCK", 64)
    monkeypatch.setattr(quadtree, "GROUP_PLACES", 200)
    seen = []
    plain = quadtree.Tree.with_spots

    def spy(self, pairs, keep):
        out = plain(self, pairs, keep)
        seen.append(out.count())
        return out

    monkeypatch.setattr(quadtree.Tree, "with_spots", spy)
    rng = np.random.default_rng(3)
    fac = np.concatenate([rng.uniform(0, 9000, (900, 2)), rng.normal(4000, 50, (300, 2))])
    pts = np.concatenate([rng.uniform(0, 9000, (800, 2)), rng.normal(4000, 800, (400, 2))])
    pts = np.concatenate([pts, pts[:60]])   # places that repeat
    kind = np.arange(len(fac)) % 2
    df = spark.createDataFrame([(i, float(x), float(y), "ab"[k]) for i, ((x, y), k) in enumerate(zip(fac, kind))],
                               "facility_id long, x double, y double, amenity string")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    got = {r.id: r for r in spatial.count_within(points, df, "id", (1000, 3000), ["a", "b"]).collect()}
    assert len(got) == len(pts) and seen[0] < 4 * len(pts)   # point by point: hundreds of spots for each
    d2 = (pts[:, :1] - fac[:, 0]) ** 2 + (pts[:, 1:] - fac[:, 1]) ** 2
    for name, k in (("a", 0), ("b", 1)):
        for r in (1000, 3000):
            want = ((d2 <= r * r) & (kind == k)).sum(axis=1)
            assert [got[i][f"{name}_count_{r // 1000}km"] for i in range(len(pts))] == want.tolist()


def test_no_points_or_facilities(spark):
    none = spark.createDataFrame([], "facility_id long, x double, y double, amenity string")
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 5.0, 0.0), (None, 0.0, 0.0)], "id long, x double, y double")
    one = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, -0.0, 0.0, "a")], none.schema)
    assert sorted(r.a_count_1km for r in spatial.count_within(points, none, "id", (1000,), ["a"]).collect()) == [0, 0]
    assert spatial.count_within(points.limit(0), one, "id", (1000,), ["a"]).count() == 0
    assert {r.id: r.a_count_1km for r in spatial.count_within(points, one, "id", (1000,), ["a"]).collect()} == {1: 4, None: 2}
