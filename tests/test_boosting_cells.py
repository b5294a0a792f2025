"""Passes of the boosted trees go over cells of equal bins, and quantiles count each value once a pass."""

import numpy as np
import pytest
from test_boosting import brute

from regionlens.operators import boosting
from regionlens.operators import quantile as Q


def test_passes_over_cells_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, float(rng.integers(0, 5)) if i % 7 else None, float(rng.integers(0, 4)), float(np.round(rng.normal(50, 9), 4)),
             i % 3 if i % 13 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y double, fold int").repartition(5)
    seen = []
    plain = boosting._histogram
    monkeypatch.setattr(boosting, "_histogram", lambda margins, *args: seen.append(margins.count()) or plain(margins, *args))
    kw = dict(rounds=3, depth=3, rate=0.4, lam=1.0, least=1.0)
    models, out = boosting.fit(df, ["a", "b"], "y", bins=6, fold="fold", folds=3, **kw)
    assert set(seen) == {len({r[1:3] for r in rows})}  # before: 400
    got = {r.id: r.prediction for r in out.collect()}
    y = [r[3] for r in rows]
    scale = boosting.gradient_scale(len(y), max(y) - min(y))
    for k, m in enumerate(models):
        train = [r for r in rows if r[4] != k]
        want = dict(zip((r[1:3] for r in train), brute([(r[1:3], r[3]) for r in train], m.features, m.cuts, m.base, scale, **kw)))
        held = [r for r in rows if r[4] == k]
        assert [got[r[0]] for r in held] == pytest.approx([want[r[1:3]] for r in held], rel=1e-9)
    assert all(got[r[0]] is None for r in rows if r[4] is None)


@pytest.mark.parametrize("by", [["g"], []])
def test_values_counted_once_a_pass(spark, monkeypatch, by):
    rng = np.random.default_rng(4)
    values = {g: np.round(rng.normal(0, 50, 3000), 1) for g in ("p", "q")}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    qs = [i / 64 for i in range(1, 64)]
    pairs = []
    plain = Q._attach

    def spy(*args):
        out = plain(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(Q, "_attach", spy)
    got = {(getattr(r, "g", None), r.q): r.v for r in Q.exact_quantiles(df, "v", qs, by, limit=100, buckets=16).collect()}
    assert len(pairs) > 2 and max(pairs) <= 6000  # before: 126 times as many in the first pass
    want = values if by else {None: np.concatenate([*values.values()])}
    assert {k: pytest.approx(v) for k, v in got.items()} == {(g, q): np.quantile(vs, q) for g, vs in want.items() for q in qs}
