"""Cross-product sums against numpy, and the linear models that follow from them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regionlens.operators import evaluate, moments, profile
from regionlens.operators import model as M


def frame(spark, seed, n, d, gaps=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + rng.normal(size=(n, 1)) + 1e6 * np.arange(d)
    x[rng.random((n, d)) < gaps] = np.nan
    pdf = pd.DataFrame(x, columns=[f"v.{i}" for i in range(d)])
    pdf["fold"] = [None if i % 17 == 3 else i % 4 for i in range(n)]
    pdf["fold"] = pdf["fold"].astype("Int64")
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_200_columns_pairwise_in_blocks(spark):
    pdf, df = frame(spark, 0, 300, 200, gaps=0.2)
    cols = list(pdf.columns[:200])
    got = {(r.a, r.b): r.r for r in profile.corr_matrix(df, cols).collect()}
    want = pdf[cols].corr().to_numpy()
    assert len(got) == 200 * 200
    assert np.allclose([[got[a, b] for b in cols] for a in cols], want, atol=1e-9)


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, float("nan")), (2.0, 5.0, None, 3.0), (None, 5.0, 1.0, 4.0), (4.0, 5.0, 2.0, 9.0)],
                               "a double, c double, few double, n double")
    got = {(r.a, r.b): r.r for r in profile.corr_matrix(df).collect()}
    assert got["a", "c"] is None and got["c", "c"] is None and got["a", "few"] is None
    assert got["a", "a"] == pytest.approx(1.0) and got["a", "n"] == pytest.approx(1.0)
    assert got["few", "n"] == pytest.approx(1.0)
    assert {r.r for r in profile.corr_matrix(df.where("false")).collect()} == {None}


@pytest.mark.parametrize("penalty", [0.0, 7.0])
def test_folds_from_totals(spark, penalty):
    pdf, df = frame(spark, 1, 240, 5, gaps=0.03)
    cols = list(pdf.columns[:5])
    models, train = moments.cross_validate(df, cols[:4], cols[4], "fold", penalty)
    assert sorted(models) == [0, 1, 2, 3]
    for f, (w, b) in models.items():
        rows = pdf[(pdf["fold"] != f).fillna(True)][cols].dropna().to_numpy()
        x, y = rows[:, :4] - rows[:, :4].mean(0), rows[:, 4] - rows[:, 4].mean()
        want = np.linalg.solve(x.T @ x + penalty * np.eye(4), x.T @ y)
        assert np.allclose(w, want, rtol=1e-6) and b == pytest.approx(rows[:, 4].mean() - rows[:, :4].mean(0) @ want, rel=1e-6)
        assert train[f].rows == len(rows)
        residual = rows[:, 4] - rows[:, :4] @ w - b
        assert train[f].squared_error(w, b) == pytest.approx((residual ** 2).sum(), rel=1e-6)
        assert train[f].r2(w, b) == pytest.approx(1 - (residual ** 2).sum() / (y ** 2).sum(), rel=1e-6)
    predicted = moments.predict_folds(df, cols[:4], models).where("fold is null or `v.0` is null").collect()
    assert predicted and all(r.predicted is None for r in predicted)


def test_grid_search_brute(spark):
    pdf, df = frame(spark, 2, 160, 4)
    cols = list(pdf.columns[:4])
    scores, (w, b) = moments.grid_search(df, cols[:3], cols[3], [0.0, 0.5, 50.0], "fold")
    rows = pdf[cols].to_numpy()
    fold = pdf["fold"].fillna(-1).to_numpy(dtype=int)

    def fit(x, y, lam):
        dev = x.std(0, ddof=1)
        z, yc = (x - x.mean(0)) / dev, y - y.mean()
        v = np.linalg.solve(z.T @ z / len(y) + lam / y.std() * np.eye(3), z.T @ yc / len(y)) / dev
        return v, y.mean() - x.mean(0) @ v

    for lam, score in scores:
        errors = []
        for f in range(4):
            tr, te = rows[fold != f], rows[fold == f]
            v, c = fit(tr[:, :3], tr[:, 3], lam)
            errors.append(np.sqrt(((te[:, 3] - te[:, :3] @ v - c) ** 2).mean()))
        assert score == pytest.approx(np.mean(errors), rel=1e-6)
    best = min(scores, key=lambda s: s[1])[0]
    assert np.allclose(w, fit(rows[:, :3], rows[:, 3], best)[0], rtol=1e-6)


def test_singular_and_empty(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0, 5.0 * i + 1, i % 2) for i in range(20)],
                               "a double, twice double, flat double, y double, fold int")
    models, _ = moments.cross_validate(df, ["a", "twice", "flat"], "y")
    for w, b in models.values():
        assert w[0] + 2 * w[1] == pytest.approx(5.0) and w[2] == 0.0 and b == pytest.approx(1.0)
    assert moments.sums(df.where("false"), ["a"]) == {}
    assert moments.grid_search(df.where("false"), ["a"], "y", [0.0])[0] == []
    assert moments.cross_validate(df.where("false"), ["a"], "y") == ({}, {})


def test_sparsity_study_levels_are_one_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float(2 * a - b)) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y double")
    res = {r.mask_pct: r for r in M.sparsity_study(df, "id", ["a", "b"], "y", ["a", "b"], [0.0, 0.25, 0.5]).collect()}
    assert sorted(res) == [0.0, 25.0, 50.0] and res[0.0].R2 == pytest.approx(1.0)
    assert res[0.0].RMSE < res[25.0].RMSE < res[50.0].RMSE
    assert {r.n for r in res.values()} == {80}
    assert set(evaluate.METRICS) <= set(res[0.0].asDict())
