"""Data profiling and the data behind the reference's plots
(P11, P12, A3-A5, A7, A23-A25, A27, O1-O5).

Each profile is one aggregate pass over the table (partial aggregation
before the shuffle), unpivoted to one row per column afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.operators import moments
from regionlens.operators.clean import numeric_columns


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """P11 first-n rows after an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def schema_profile(df: DataFrame) -> DataFrame:
    """P12 name, Spark type and non-NULL count per column, in one pass."""
    counts = df.agg(*[F.count(_q(c)).alias(f"_{i}") for i, c in enumerate(df.columns)])
    stack = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                               F.lit(f.dataType.simpleString()).alias("type"),
                               F.col(f"_{i}").alias("non_null"))
                      for i, f in enumerate(df.schema.fields)])
    return counts.select(F.inline(stack))


def null_profile(df: DataFrame) -> DataFrame:
    """A3 NULL count per column in one pass, then one row per column."""
    counts = df.agg(*[F.count_if(_q(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])
    stack = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("null_count"))
                      for i, c in enumerate(df.columns)])
    return counts.select(F.inline(stack))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4 exact distinct count per column (one aggregate; Spark expands the
    distinct aggregates into one shared shuffle)."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_distinct(_q(c)).alias(f"_{i}") for i, c in enumerate(cols)])
    stack = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_distinct"))
                      for i, c in enumerate(cols)])
    return counts.select(F.inline(stack))


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A5 count, mean, sample std, min, exact quartiles, max per numeric
    column (``df.summary`` uses approximate quantiles, so it is not used)."""
    from regionlens.operators.quantile import global_quantiles

    cols = list(cols or numeric_columns(df))
    qv = global_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        v = _q(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"),
                 F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    one = df.agg(*aggs)

    def lit(c, q):
        return F.lit(qv.get((c, q))).cast("double")

    stack = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"mean{i}").alias("mean"),
        F.col(f"std{i}").alias("std"), F.col(f"min{i}").alias("min"),
        lit(c, 0.25).alias("p25"), lit(c, 0.5).alias("p50"), lit(c, 0.75).alias("p75"),
        F.col(f"max{i}").alias("max")) for i, c in enumerate(cols)])
    return one.select(F.inline(stack))


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A7 Pearson correlation of every pair, pairwise-complete (each pair
    skips rows where either side is NULL): one pass of blocked products of
    values and presence (`moments.sums`).  NULL without variance or two rows."""
    cols = list(cols or numeric_columns(df))
    found = moments.sums(df, cols, complete=False)
    r = found[None].correlations() if found else np.full((len(cols), len(cols)), np.nan)
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def _range(df: DataFrame, col: str):
    r = df.agg(F.min(_q(col)).alias("lo"), F.max(_q(col)).alias("hi"), F.count(_q(col)).alias("n"),
               F.stddev_samp(_q(col)).alias("sd")).first()
    return r["lo"], r["hi"], r["n"], r["sd"]


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """A23 equal-width histogram between min and max, the maximum in the last
    bin, empty bins kept.  Bin of v = least(floor((v-lo)*bins/(hi-lo)), bins-1)."""
    lo, hi, n, _ = _range(df, col)
    spark = df.sparkSession
    if n == 0:
        return spark.range(0).select(F.lit(0).alias("bin"), F.lit(0.0).alias("lo"),
                                     F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("count"))
    width = (hi - lo) if hi > lo else 1.0
    v = _q(col).cast("double")
    b = F.least(F.floor((v - F.lit(lo)) * F.lit(float(bins)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width) / F.lit(float(bins))).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width) / F.lit(float(bins))).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def kde_curve(df: DataFrame, col: str, points: int = 100) -> DataFrame:
    """A24 Gaussian kernel density on a grid between min and max, Scott
    bandwidth h = sd * n^(-1/5).

    No join: each value row generates its ``points`` kernel contributions
    (``explode`` over a fixed-size grid), and the per-grid-point sums are
    partially aggregated inside the same stage before the shuffle.  Output
    ``density_x_range`` = density * (max - min), dimensionless.
    """
    lo, hi, n, sd = _range(df, col)
    spark = df.sparkSession
    if not n or n < 2 or not sd:
        return spark.range(0).select(F.lit(0).alias("k"), F.lit(0.0).alias("x"),
                                     F.lit(0.0).alias("density_x_range"))
    h = sd * n ** (-0.2)
    step = (hi - lo) / (points - 1)
    v = _q(col).cast("double")
    ex = df.where(v.isNotNull()).select(v.alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    g = F.lit(lo) + F.col("k") * F.lit(step)
    u = (g - F.col("_v")) / F.lit(h)
    dens = ex.groupBy("k").agg(F.sum(F.exp(-0.5 * u * u)).alias("_s"))
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    return dens.select("k", (F.lit(lo) + F.col("k") * F.lit(step)).alias("x"),
                       (F.col("_s") * F.lit(norm) * F.lit(hi - lo)).alias("density_x_range"))


def _quartiles(base: DataFrame, group: str) -> DataFrame:
    """q1, median, q3, iqr per group of ``base`` (group, _v), and the fences 1.5 IQR beyond the quartiles, stored."""
    from regionlens.operators.quantile import exact_quantiles
    from regionlens.session import materialize

    ql = exact_quantiles(base, "_v", [0.25, 0.5, 0.75], [group])
    q = ql.groupBy(group).agg(F.max(F.when(F.col("q") == 0.25, F.col("_v"))).alias("q1"),
                              F.max(F.when(F.col("q") == 0.5, F.col("_v"))).alias("median"),
                              F.max(F.when(F.col("q") == 0.75, F.col("_v"))).alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    return materialize(q.withColumns({"_lo": F.col("q1") - 1.5 * F.col("iqr"), "_hi": F.col("q3") + 1.5 * F.col("iqr")}),
                       "quartiles")


def boxplot_stats(df: DataFrame, group: str, col: str) -> DataFrame:
    """A25 per group: quartiles, whiskers at the most extreme values within
    1.5 IQR, and the number of outliers.  Two aggregates: quartiles per group,
    then whiskers and outlier counts; the quartiles are joined back by
    broadcast if measured small, else with hot groups split."""
    from regionlens.operators.spatial import cell_join

    v = _q(col).cast("double")
    base = df.where(v.isNotNull() & _q(group).isNotNull()).select(_q(group).alias(group), v.alias("_v"))
    j = cell_join(base, _quartiles(base, group), [group])
    return j.groupBy(group, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(F.col("_v") <= F.col("_hi"), F.col("_v"))).alias("whisker_hi"),
        F.count_if((F.col("_v") < F.col("_lo")) | (F.col("_v") > F.col("_hi"))).alias("n_outliers"))


def boxplot_outliers(df: DataFrame, group: str, col: str) -> DataFrame:
    """A25 the rows of ``df`` whose value lies more than 1.5 IQR beyond its group's quartiles.
    Rows without a group or value are none."""
    from regionlens.operators.spatial import cell_join

    v = _q(col).cast("double")
    rows = df.where(v.isNotNull() & _q(group).isNotNull())
    q = _quartiles(rows.select(_q(group).alias(group), v.alias("_v")), group).select(group, "_lo", "_hi")
    out = cell_join(rows, q, [group])
    return out.where((v < F.col("_lo")) | (v > F.col("_hi"))).select(*[_q(c) for c in df.columns])


def symmetric_range(df: DataFrame, col: str) -> DataFrame:
    """A27 min, max and max |value| (symmetric colour range of an error map)."""
    return df.agg(F.min(_q(col)).alias("vmin"), F.max(_q(col)).alias("vmax"),
                  F.max(F.abs(_q(col))).alias("vabs"))


def top_k(df: DataFrame, value: str, k: int = 10, by_abs: bool = False) -> DataFrame:
    """O1 sort descending, O2 by absolute value with the sign kept, O3 keep
    the first k (TakeOrderedAndProject, no full sort)."""
    key = F.abs(_q(value)) if by_abs else _q(value)
    return df.orderBy(key.desc()).limit(k)
