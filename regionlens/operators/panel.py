"""Panel time series: wide/long reshaping, per-year statistics, lags
(P5-P8, A1, A2, A6, A28, W1, W2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionlens.operators.clean import relabel

# Quantile labels of the per-year quantile table.
QUANTILE_LABELS = {0.05: "5th Percentile", 0.25: "25th Percentile", 0.75: "75th Percentile"}


def year_columns(df: DataFrame, lo: int | None = None, hi: int | None = None,
                 before: int | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """P5 digit-named columns in [lo, hi], or all years before ``before``."""
    out = []
    for c in df.columns:
        if not c.isdigit() or c in exclude:
            continue
        y = int(c)
        if lo is not None and y < lo or hi is not None and y > hi:
            continue
        if before is not None and y >= before:
            continue
        out.append(c)
    return out


def melt(df: DataFrame, ids: Sequence[str], year_col: str = "year", value_col: str = "gdp",
         strict: bool = False) -> DataFrame:
    """P6 wide -> long over the digit-named columns; NULL values are kept.
    P8: the year label is cast to int (``strict`` raises on a bad label,
    otherwise it becomes NULL)."""
    years = year_columns(df)
    long = df.unpivot(list(ids), [F.col(f"`{y}`").cast("double").alias(y) for y in years],
                      "_label", value_col)
    label = F.col("_label")
    y = label.cast("int") if strict else label.try_cast("int")
    return long.withColumn(year_col, y).drop("_label").select(*ids, year_col, value_col)


def to_wide(long: DataFrame, id_col: str, years: Sequence[int], year_col: str = "year",
            value_col: str = "gdp") -> DataFrame:
    """P7 long -> wide with an explicit year list (no extra pass to find the
    pivot values)."""
    return long.groupBy(id_col).pivot(year_col, list(years)).agg(F.first(value_col))


def mean_by_year(long: DataFrame, year_col: str = "year", value_col: str = "gdp") -> DataFrame:
    """A1 mean per year, NULL values and NULL years skipped."""
    return (long.where(F.col(year_col).isNotNull()).groupBy(year_col)
            .agg(F.avg(value_col).alias(f"mean_{value_col}")))


def quantiles_by_year(long: DataFrame, qs: Sequence[float] = (0.05, 0.25, 0.75),
                      year_col: str = "year", value_col: str = "gdp") -> DataFrame:
    """A2 + P9 linear-interpolated quantiles per year, one row per quantile,
    labelled through a literal map."""
    from regionlens.operators.quantile import exact_quantiles

    q = exact_quantiles(long.where(F.col(year_col).isNotNull()), value_col, qs, [year_col])
    return q.select(year_col, F.col("q").alias("quantile"), relabel(F.col("q"), QUANTILE_LABELS).alias("label"),
                    F.col(value_col).alias("value"))


def row_mean(df: DataFrame, cols: Sequence[str], name: str = "row_mean") -> DataFrame:
    """A6 row-wise mean over year columns, NULLs skipped (NULL if all NULL)."""
    arr = F.filter(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]), lambda x: x.isNotNull())
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumn(name, F.try_divide(total, F.size(arr).cast("double")))


def trend_slope(long: DataFrame, id_col: str, year_col: str = "year",
                value_col: str = "gdp") -> DataFrame:
    """A28 least-squares slope of value over year per region."""
    return long.groupBy(id_col).agg(
        F.regr_slope(F.col(value_col), F.col(year_col).cast("double")).alias("slope"),
        F.regr_count(F.col(value_col), F.col(year_col).cast("double")).alias("n_years"))


def lag_features(long: DataFrame, id_col: str, lags: Sequence[int] = (1, 2), year_col: str = "year",
                 value_col: str = "gdp") -> DataFrame:
    """W1 lagged values and W2 year-on-year growth over one window per region
    (the window is partitioned by region, so it shuffles once on the id)."""
    w = Window.partitionBy(id_col).orderBy(year_col)
    out = long
    for k in lags:
        out = out.withColumn(f"{value_col}_lag{k}", F.lag(value_col, k).over(w))
    prev = F.lag(value_col, 1).over(w)
    return out.withColumn("growth", F.try_divide(F.col(value_col) - prev, prev))
