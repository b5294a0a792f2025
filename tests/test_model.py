"""Model operators: scaler, closed-form parity, persistence."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from regionlens.operators import model as M
from regionlens.sources import fixtures as fx

FEATS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def frame(spark):
    return fx.features(spark, SF_SMALL).na.drop().cache()


def test_scaler_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    st = M.fit_scaler(df, ["a", "c"])
    assert st["a"][1] == pytest.approx(np.std([1, 2, 3]))
    assert st["c"] == (5.0, 1.0)
    out = [r.c for r in M.apply_scaler(df, st).collect()]
    assert out == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("alpha", [0.0, 10.0, 1e5])
def test_linear_models_match_closed_form(frame, alpha):
    pdf = frame.toPandas()
    X, y = pdf[FEATS].values, pdf["target"].values
    Xc, yc = X - X.mean(0), y - y.mean()
    b = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    est = M.ridge(frame, "target", alpha) if alpha else M.ols("target")
    m = est.fit(M.assemble(frame, FEATS))
    assert np.allclose(np.array(m.coefficients), b, rtol=1e-8)
    assert m.intercept == pytest.approx(y.mean() - X.mean(0) @ b, rel=1e-8)


def test_save_and_load_pipeline(spark, frame):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol=M.VEC), M.ols("target")])
    model = pipe.fit(frame)
    path = os.path.join(tempfile.mkdtemp(prefix="rl-model-"), "m")
    M.save_model(model, path)
    back = M.load_model(path)
    a = model.transform(frame).select("prediction").collect()
    b = back.transform(frame).select("prediction").collect()
    assert a == b


def test_spatial_cv_folds_and_summary(spark, frame):
    from regionlens.operators import split
    f = split.group_folds(frame, "tract", 5)
    per_fold, summary = M.spatial_cv(f, "geoid", FEATS, "target", lambda tr: M.ols("target"))
    assert sorted(r.fold for r in per_fold.collect()) == [0, 1, 2, 3, 4]
    assert {r.metric for r in summary.collect()} == {"MAE", "RMSE", "R2", "MAPE"}


def test_importances_sorted(spark, frame):
    m = M.random_forest("target", num_trees=5, max_depth=4).fit(M.assemble(frame, FEATS))
    imp = [r.importance for r in M.importances(m, FEATS, spark).collect()]
    assert imp == sorted(imp, reverse=True) and sum(imp) == pytest.approx(1.0)
