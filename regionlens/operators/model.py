"""Models through ``pyspark.ml``.

Training data never leaves the executors: scaler statistics are one
aggregate, estimators are Spark ML's distributed ones, and every metric is
an aggregate over a predictions DataFrame that carries an explicit key.
Only model parameters (coefficients, importances, per-fold metric rows)
come back to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.operators import clean, evaluate, moments, split
from regionlens.session import materialize

VEC = "_features"


# ---------------------------------------------------------------- M1

def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """M1 mean and *population* std per column in one aggregate; a constant
    column gets std 1 (divide by 1, not 0)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    out = {}
    for c in cols:
        s = row[f"s_{c}"]
        out[c] = (row[f"m_{c}"] or 0.0, s if s not in (None, 0.0) else 1.0)
    return out


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Apply fitted (mean, std) as literals: (x - mean) / std."""
    out = []
    for c in df.columns:
        if c in stats:
            m, s = stats[c]
            out.append(((F.col(c) - F.lit(m)) / F.lit(s)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------- M2-M5

def ols(label: str = "label") -> LinearRegression:
    """M2 ordinary least squares (normal equations)."""
    return LinearRegression(featuresCol=VEC, labelCol=label, regParam=0.0, elasticNetParam=0.0,
                            solver="normal", standardization=False)


def ridge(train: DataFrame, label: str, alpha: float = 1.0) -> LinearRegression:
    """M3 ridge with sklearn's penalty alpha*||w||^2 on unscaled features
    (intercept not penalised).

    With the normal solver and ``standardization=False`` this is
    ``regParam = alpha * stddev_pop(label) / n``; checked against the closed
    form (X'X + alpha I)^-1 X'y on centred data to ~1e-12 relative."""
    row = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    lam = alpha * row["s"] / row["n"] if row["n"] and row["s"] else 0.0
    return LinearRegression(featuresCol=VEC, labelCol=label, regParam=lam, elasticNetParam=0.0,
                            solver="normal", standardization=False)


def random_forest(label: str = "label", seed: int = 42, num_trees: int = 100, max_depth: int = 30):
    """M4 random forest: 100 trees, all features per split, deep trees."""
    return RandomForestRegressor(featuresCol=VEC, labelCol=label, numTrees=num_trees,
                                 featureSubsetStrategy="all", maxDepth=max_depth, seed=seed)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """P10 assemble the feature columns into one vector column."""
    return VectorAssembler(inputCols=list(features), outputCol=VEC).transform(df)


# ---------------------------------------------------------------- M6, M10

def coefficients(model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Intercept and coefficients of a fitted linear model as rows."""
    rows = [("intercept", float(model.intercept))]
    rows += [(f, float(v)) for f, v in zip(features, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "term string, value double")


def importances(model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """M10 tree importances, or |coefficient| for linear models, sorted."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray()
    else:
        vals = [abs(v) for v in model.coefficients.toArray()]
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, vals)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature")


def fit_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, estimator,
                key: str, scale: bool = True) -> tuple[DataFrame, object]:
    """M6 scale on the training rows only (M1), fit, predict the test rows.
    Returns (key, actual, predicted) rows and the fitted model."""
    if scale:
        st = fit_scaler(train, features)
        train, test = apply_scaler(train, st), apply_scaler(test, st)
    model = estimator.fit(assemble(train, features))
    pred = model.transform(assemble(test, features)).select(
        key, F.col(label).alias("actual"), F.col("prediction").alias("predicted"))
    return pred, model


# ---------------------------------------------------------------- M7, M8

def spatial_cv(df: DataFrame, key: str, features: Sequence[str], label: str,
               make_estimator: Callable[[DataFrame], object], fold: str = "fold",
               k: int = 5, models: list | None = None) -> tuple[DataFrame, DataFrame]:
    """M7 grouped cross-validation: per fold a scaler fitted on the other
    folds and a fresh estimator; predictions of all folds are unioned with
    their fold id (U5 append of per-fold results), then metrics per fold
    (A15) and their mean/std (A16) are plain aggregates.  The folded table is
    written once, as every fold reads it several times.  Returns (per-fold
    metrics, summary); the fitted models are appended to ``models`` if given."""
    df = materialize(df.select(key, *features, label, fold), "folded")
    preds = None
    for f in range(k):
        train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        p, m = fit_predict(train, test, features, label, make_estimator(train), key)
        if models is not None:
            models.append(m)
        p = p.withColumn(fold, F.lit(f))
        preds = p if preds is None else preds.unionByName(p)
    per_fold = evaluate.regression_metrics(preds, [fold])
    return per_fold, evaluate.fold_summary(per_fold)


# ---------------------------------------------------------------- M11

def sparsity_study(df: DataFrame, key: str, features: Sequence[str], label: str, mask_cols: Sequence[str],
                   percentages: Sequence[float], alpha: float = 0.0, seed: int = 42) -> DataFrame:
    """M11 for each masking percentage: mask exactly int(n*p) values per
    chosen column (W7), median-impute (A14), fit least squares with penalty
    ``alpha`` on columns scaled with the full data's deviations (M1) and score on the
    same rows.  One metrics row per p.  The masked tables are one table with
    the percentage as group: one pass for the sums of all models, one for the metrics."""
    full = moments.sums(df, list(features))
    if None not in full:
        raise ValueError("no complete rows to fit")
    scale = np.sqrt(np.diag(full[None].cov()))
    levels = None
    for i, p in enumerate(percentages):
        m = split.mask_cells(df, key, mask_cols, p, seed) if p > 0 else df
        m = clean.median_impute(m, list(mask_cols)).withColumn("_level", F.lit(i))
        levels = m if levels is None else levels.unionByName(m)
    groups = moments.sums(levels, [*features, label], F.col("_level"))
    models = {i: s.solve(alpha / max(s.rows, 1), scale) for i, s in groups.items()}
    rows = moments.predict_folds(levels, features, models, "_level").select(
        "_level", F.col(label).alias("actual"), "predicted")
    percent = F.element_at(F.array(*[F.lit(float(p) * 100) for p in percentages]), F.col("_level") + 1)
    return evaluate.regression_metrics(rows, ["_level"]).withColumn("mask_pct", percent).drop("_level")


# ---------------------------------------------------------------- M9, M17, M18

def r2_scores(df: DataFrame, key: str, features: Sequence[str], label: str, test_frac: float = 0.25,
              seed: int = 42, k: int = 5) -> DataFrame:
    """M9 OLS R^2 on the training rows, on the test rows, and the mean R^2
    of a contiguous k-fold CV over the training rows: one pass over the
    split table gives the sums of every fold, the rest is arithmetic."""
    s = materialize(split.exact_split(df, key, test_frac, seed), "split")
    folds = split.contiguous_folds(s.where(~F.col("is_test")), key, k)
    # one group per training fold, -1 for the test rows
    groups = moments.sums(folds.unionByName(s.where("is_test").withColumn("fold", F.lit(-1))), [*features, label], F.col("fold"))
    test = groups.pop(-1, None)
    train = moments.total(list(groups.values())) if groups else None
    model = train.solve() if train else None
    cv = [v for v in (g.r2(*(train - g).solve()) for g in groups.values()) if v is not None]
    rows = [("r2_train", train.r2(*model) if train else None),
            ("r2_test", test.r2(*model) if train and test else None),
            ("r2_cv_mean", sum(cv) / len(cv) if cv else None),
            ("n_train", float(train.rows if train else 0)), ("n_test", float(test.rows if test else 0))]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def population_regression(panel_wide: DataFrame, population: DataFrame, year: int,
                          feature_cols: Sequence[str]) -> DataFrame:
    """M17 J2 join on iso3 = ISO3_code -> F7 complete rows -> W3 75/25 ->
    OLS -> M9 scores, target = the chosen year's value."""
    y = str(year)
    j = panel_wide.join(population, panel_wide.iso3 == population.ISO3_code, "left")
    j = j.select("iso3", F.col(f"`{y}`").alias("label"), *[F.col(c).cast("double").alias(c) for c in feature_cols])
    j = clean.drop_incomplete(j, ["label", *feature_cols])
    return r2_scores(j, "iso3", list(feature_cols), "label")


def lagged_regression(panel_wide: DataFrame, year: int) -> DataFrame:
    """M18 W1 all years before the target year as features -> F7 -> W3 ->
    OLS -> M9 scores."""
    from regionlens.operators.panel import year_columns
    lags = year_columns(panel_wide, before=year)
    j = panel_wide.select("iso3", F.col(f"`{year}`").alias("label"),
                          *[F.col(f"`{c}`").alias(f"y{c}") for c in lags])
    feats = [f"y{c}" for c in lags]
    j = clean.drop_incomplete(j, ["label", *feats])
    return r2_scores(j, "iso3", feats, "label")


# ---------------------------------------------------------------- S14

def save_model(model, path: str) -> None:
    """S14 persist a fitted model (Spark ML writer, overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
