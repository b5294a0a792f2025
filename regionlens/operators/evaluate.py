"""Metrics and evaluation studies on prediction tables
(A15-A19, X6-X9, F17, M12-M16).

A prediction table has an explicit key (``geoid``), ``actual`` and
``predicted``; rows are never paired by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.operators.profile import symmetric_range

METRICS = ["MAE", "RMSE", "R2", "MAPE"]
HIGHER_IS_BETTER = {"R2"}


def metric_columns(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    """A15 MAE, RMSE, R^2 and MAPE as aggregate columns (one pass).

    R^2 = 1 - SSE / SST, with SST = sum(y^2) - n * mean(y)^2 expressed as
    n * var_pop(y).  MAPE skips rows whose actual value is zero and reports
    how many were skipped (``mape_skipped``)."""
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    return [
        F.avg(F.abs(e)).alias("MAE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("R2"),
        (F.avg(F.abs(F.try_divide(e, F.when(y != 0, y)))) * 100).alias("MAPE"),
        F.count_if(y == 0).alias("mape_skipped"),
        F.count(F.lit(1)).alias("n"),
    ]


def regression_metrics(pred: DataFrame, by: Sequence[str] = (), actual: str = "actual",
                       predicted: str = "predicted") -> DataFrame:
    """A15 per group (or overall)."""
    cols = metric_columns(actual, predicted)
    return pred.groupBy(*by).agg(*cols) if by else pred.agg(*cols)


def fold_summary(fold_metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A16 mean and population std of each metric across folds, one row per
    (group, metric)."""
    stack = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in METRICS])
    long = fold_metrics.select(*by, F.inline(stack))
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"),
                                          F.stddev_pop("value").alias("std"))


# ---------------------------------------------------------------- policy

def income_class(c, threshold: float) -> Column:
    """X6 low / other income by ``<=`` threshold; NULL -> other_income."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col <= threshold, F.lit("low_income")).otherwise(F.lit("other_income"))


def policy_metrics(pred: DataFrame, threshold: float, actual: str = "actual",
                   predicted: str = "predicted") -> DataFrame:
    """X6 + A17 precision and recall of the low-income class (0 when the
    denominator is 0)."""
    a = income_class(actual, threshold) == "low_income"
    p = income_class(predicted, threshold) == "low_income"
    tp = F.count_if(a & p)
    return pred.agg(
        F.coalesce(F.try_divide(tp.cast("double"), F.count_if(p).cast("double")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp.cast("double"), F.count_if(a).cast("double")), F.lit(0.0)).alias("recall"),
        tp.alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"),
        F.count_if(~a & ~p).alias("tn"))


def confusion(pred: DataFrame, threshold: float, actual: str = "actual",
              predicted: str = "predicted") -> DataFrame:
    """A18 confusion matrix, labels = O4 sorted distinct *true* classes only
    (a bounded list: the two classes); one row per (actual, predicted)
    label pair, zero-filled."""
    labels = sorted(r["label"] for r in pred.select(
        income_class(actual, threshold).alias("label")).distinct().collect())
    cls = pred.select(income_class(actual, threshold).alias("actual_class"),
                      income_class(predicted, threshold).alias("predicted_class"))
    wide = cls.groupBy("actual_class").pivot("predicted_class", labels).count()
    long = wide.unpivot("actual_class", [F.col(f"`{l}`") for l in labels], "predicted_class", "count")
    return long.select("actual_class", "predicted_class",
                       F.coalesce("count", F.lit(0)).cast("long").alias("count"))


# ---------------------------------------------------------------- subgroups

def urban_rural(pred: DataFrame, density: str, whole: DataFrame | None = None) -> DataFrame:
    """X7 + F17 + A19 urban/rural MAE and RMSE: urban when density is above
    the median density of ``whole``, the feature matrix that the predicted rows
    are part of (default: the predicted rows themselves); ties and NULL density
    -> rural.  The median is one scalar aggregate applied as a literal (J11)."""
    from regionlens.operators.quantile import global_quantiles

    med = global_quantiles(pred if whole is None else whole, [density], [0.5]).get((density, 0.5))
    cls = F.when(F.col(density) > F.lit(med), F.lit("urban")).otherwise(F.lit("rural")) \
        if med is not None else F.lit("rural")
    e = F.col("actual") - F.col("predicted")
    return (pred.withColumn("area_type", cls).groupBy("area_type")
            .agg(F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"),
                 F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- degradation

def degradation(initial: Column, degraded: Column, higher_is_better: Column) -> Column:
    """X8 percentage degradation (NULL stands for NaN, +inf kept as infinity).

    higher-is-better: initial 1 -> 0 if degraded is 1 else inf; initial 0 ->
    100 if degraded < 0 else 0; initial < 0 -> (i - d)/|i|*100; else
    (i - d)/i*100.  lower-is-better: initial 0 -> inf if degraded > 0 else 0;
    else (d - i)/i*100."""
    i, d = initial, degraded
    inf = F.lit(float("inf"))
    hib = (F.when(i == 1.0, F.when(d == 1.0, 0.0).otherwise(inf))
           .when(i == 0.0, F.when(d < 0.0, 100.0).otherwise(0.0))
           .when(i < 0.0, (i - d) / F.abs(i) * 100)
           .otherwise((i - d) / i * 100))
    lib = F.when(i == 0.0, F.when(d > 0, inf).otherwise(0.0)).otherwise((d - i) / i * 100)
    return F.when(i.isNull() | d.isNull() | F.isnan(i) | F.isnan(d), F.lit(None).cast("double")) \
        .otherwise(F.when(higher_is_better, hib).otherwise(lib))


def degradation_table(metrics: DataFrame, level: str, baseline_level) -> DataFrame:
    """M12 join each level's metrics to the baseline row and apply X8 per
    metric; one row per (level, metric)."""
    stack = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in METRICS])
    long = metrics.select(level, F.inline(stack))
    base = long.where(F.col(level) == F.lit(baseline_level)).select("metric", F.col("value").alias("initial"))
    j = long.join(F.broadcast(base), "metric")
    return j.select(level, "metric", "initial", F.col("value").alias("degraded"),
                    degradation(F.col("initial"), F.col("value"),
                                F.col("metric").isin(list(HIGHER_IS_BETTER))).alias("degradation_pct"))


# ---------------------------------------------------------------- residuals

def residuals(pred: DataFrame, key: str = "geoid") -> DataFrame:
    """X9 + M16 actual, predicted and residual per key."""
    return pred.select(key, "actual", "predicted", (F.col("actual") - F.col("predicted")).alias("residual"))


def error_map(pred: DataFrame, zones: DataFrame, key: str = "geoid", zone_key: str = "county") -> DataFrame:
    """M15 the zones with the residuals of their key, and the symmetric colour
    range (A27, one scalar) attached.  Every zone stays: one without a
    prediction has no value; a prediction without a zone is not on the map."""
    res = pred.select(key, zone_key, "actual", "predicted",
                      (F.col("actual") - F.col("predicted")).alias("residual"))
    vabs = symmetric_range(res, "residual").first()["vabs"]
    z = zones.select(F.col(zone_key), F.col("geoid").alias("zone_geoid"))
    return (z.join(res, zone_key, "left")
            .withColumn("vmin", F.lit(-vabs if vabs is not None else None).cast("double"))
            .withColumn("vmax", F.lit(vabs).cast("double")))
