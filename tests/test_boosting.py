"""Boosted trees against a row-by-row version, and edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlens.operators import boosting


def brute(rows, features, cuts, base, scale, rounds, depth, rate, lam, least):
    """rows: (values, label); margins after all rounds, one row at a time."""
    bins = [[-1 if x is None or math.isnan(x) else sum(c <= x for c in cuts[f]) for f, x in zip(features, v)] for v, _ in rows]
    margin = [base] * len(rows)

    def grow(at, g, level):
        big_g, big_h = sum(g[i] for i in at), len(at)
        weight = -rate * big_g / (big_h + lam) if big_h + lam else 0.0
        best = None
        for f in range(len(features)):
            for c in range(1, len(cuts[features[f]]) + 1):
                for side in (0, 1):
                    left = [i for i in at if (bins[i][f] < 0 and side) or 0 <= bins[i][f] < c]
                    gl, hl = sum(g[i] for i in left), len(left)
                    if hl < least or big_h - hl < least:
                        continue
                    gain = gl * gl / (hl + lam) + (big_g - gl) ** 2 / (big_h - hl + lam) - big_g * big_g / (big_h + lam)
                    if best is None or gain > best[0]:
                        best = gain, left
        if level == depth or best is None or not best[0] > 1e-6:
            return {i: weight for i in at}
        left = set(best[1])
        return grow(sorted(left), g, level + 1) | grow([i for i in at if i not in left], g, level + 1)

    for _ in range(rounds):
        g = [math.floor((m - y) * scale + 0.5) / scale for m, (_, y) in zip(margin, rows)]
        weight = grow(list(range(len(rows))), g, 0) if rows else {}
        margin = [m + weight[i] for i, m in enumerate(margin)]
    return margin


SCHEMA = "id bigint, a double, b double, c double, y double, fold int, g string"


def frame(spark, seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = float(rng.integers(0, 12)), float(np.round(rng.normal(), 3))
        y = float(np.round(3 * a - 5 * (b > 0) * a + rng.normal(), 4))
        rows.append((i, a if i % 7 else None, b if i % 11 else float("nan"), 4.0, y, i % 3, "x"))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("seed,lam,least", [(0, 1.0, 1.0), (1, 0.0, 3.0), (2, 5.0, 1.0)])
def test_trees_brute(spark, seed, lam, least):
    rows, df = frame(spark, seed, 70)
    kw = dict(rounds=3, depth=3, rate=0.4, lam=lam, least=least)
    models, out = boosting.fit(df, ["a", "b", "c"], "y", bins=6, **kw)
    m = models[0]
    assert len(m.trees) == 3 and all(len(v) <= 5 for v in m.cuts.values())
    y = [r[4] for r in rows]
    scale = boosting.gradient_scale(len(y), max(y) - min(y))
    want = brute([(r[1:4], r[4]) for r in rows], m.features, m.cuts, m.base, scale, **kw)
    got = {r.id: r.prediction for r in out.collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx(want, rel=1e-9)
    again = {r.id: r.prediction for r in m.transform(df).collect()}
    assert again == pytest.approx(got, rel=1e-12)
    shares = {r.feature: r.importance for r in m.importances(spark).collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and shares["c"] == 0.0


def test_folds_grow_together_as_alone(spark, monkeypatch):
    monkeypatch.setattr(boosting, "PENDING", 2)
    _rows, df = frame(spark, 5, 90)
    models, out = boosting.fit(df, ["a", "b"], "y", rounds=5, depth=2, bins=8, fold="fold", folds=3)
    got = {r.id: r.prediction for r in out.collect()}
    cuts = models[0].cuts
    for k, m in enumerate(models):
        with monkeypatch.context() as mp:
            mp.setattr(boosting, "cut_points", lambda *a: cuts)
            # all rows set the step of the gradients, the others than fold k train
            mp.setattr(boosting, "gradient_scale", lambda n, spread, g=boosting.gradient_scale: g(90, spread))
            alone, _ = boosting.fit(df.where(F.col("fold") != k), ["a", "b"], "y", rounds=5, depth=2, bins=8)
        held = alone[0].transform(df.where(F.col("fold") == k)).collect()
        assert {r.id: r.prediction for r in held} == pytest.approx({r.id: got[r.id] for r in held}, rel=1e-6)


def test_result_independent_of_partitions(spark):
    _rows, df = frame(spark, 7, 200)
    one = boosting.fit(df.coalesce(1), ["a", "b"], "y", rounds=4, depth=3)[1]
    many = boosting.fit(df.repartition(13), ["a", "b"], "y", rounds=4, depth=3)[1]
    assert sorted(map(tuple, one.select("id", "prediction").collect())) == sorted(map(tuple, many.select("id", "prediction").collect()))


def test_edges(spark):
    _rows, df = frame(spark, 9, 12)
    models, out = boosting.fit(df.where("false"), ["a", "b"], "y", rounds=2)
    assert out.count() == 0 and models[0].trees == [] and out.columns == [*df.columns, "prediction"]
    nulls = df.withColumn("a", F.lit(None).cast("double")).withColumn("y", F.when(F.col("id") > 5, F.col("y")))
    models, out = boosting.fit(nulls, ["a"], "y", rounds=2)
    assert out.count() == 6 and models[0].cuts == {"a": []}
    flat = {round(r.prediction, 4) for r in out.collect()}
    assert len(flat) == 1
    same = df.withColumn("y", F.lit(2.5)).withColumn("fold", F.when(F.col("id") > 0, F.col("fold")))
    got = {r.id: r.prediction for r in boosting.fit(same, ["a"], "y", rounds=2, fold="fold", folds=3)[1].collect()}
    assert got.pop(0) is None and set(got.values()) == {2.5}
