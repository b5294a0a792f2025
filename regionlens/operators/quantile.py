"""Exact, linearly interpolated quantiles without an unbounded group in
one task (used by A2, A5, A10, A14, A21, A25, X7).

Spark's exact ``percentile`` / ``median`` merge every distinct value of a
group in one task.  Here each group's order statistics are found by
histogram refinement instead:

1. one pass: count, min, max per group; the target ranks follow
   ((n - 1) * q, its floor and ceiling);
2. while a target's value range still holds more than ``limit`` values,
   one pass buckets the values inside the range into ``buckets`` equal-width
   buckets (partial aggregation: at most ``buckets`` rows per range leave a
   task), and the range shrinks to the bucket holding the rank -- its exact
   min and max, so boundaries never depend on float rounding;
3. a last pass ranks only the values inside each target's (bounded) range.

Two ranges of a group are equal or share no value, so a value is counted once a
pass, however many quantiles are asked for.

Groups whose size is already within ``limit`` skip steps 2-3: their
values go to Spark's ``percentile`` aggregate, whose per-group buffer is
then bounded by ``limit``; so on small inputs this costs two passes.  Both
ways interpolate by the same formula, ``(ceil(pos) - pos) * lower + (pos -
floor(pos)) * upper``, so a result does not depend on the way in its last bit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionlens.operators.spatial import cell_join
from regionlens.session import materialize

DEFAULT_LIMIT = 200_000
DEFAULT_BUCKETS = 4096
_INF = float("inf")


def _attach(base: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Pair each value with the different ranges [lo, hi] of its group's targets
    that contain it.  Grouped: an equi-join on the group keys that broadcasts the
    ranges if they are measured small and splits hot groups if not.  Global: the
    ranges are a handful of rows, applied as literals with a filtered
    ``explode`` (no join)."""
    cols = ["lo", "hi"]
    ranges = targets.select(*by, *cols).distinct()
    inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    if by:
        return cell_join(base, ranges, by).where(inside)
    rows = ranges.collect()
    if not rows:
        return base.select("_v", *[F.lit(None).alias(c) for c in cols]).where(F.lit(False))
    arr = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in cols]) for r in rows])
    ex = base.select("_v", F.explode(F.filter(arr, lambda s: (F.col("_v") >= s.lo) & (F.col("_v") <= s.hi)))
                     .alias("_t"))
    return ex.select("_v", *[F.col(f"_t.{c}").alias(c) for c in cols])


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (),
                    limit: int = DEFAULT_LIMIT, buckets: int = DEFAULT_BUCKETS,
                    materialize_input: bool = False) -> DataFrame:
    """One row per (by..., q) with the exact interpolated quantile ``value``.
    NULL / NaN values are skipped; a group without values yields no row.  Infinite
    values rank below and above all others, whatever the size of the group.

    ``materialize_input`` writes the narrow (group, value) input once to the
    checkpoint folder -- worth it when the input is itself a join (every
    pass reads it again)."""
    by = list(by)
    v = F.col(f"`{value}`").cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(f"`{b}`").alias(b) for b in by], v.alias("_v"))
    if materialize_input:
        base = materialize(base, "quantile-input")
    # infinities are set aside by rank: the ranges to refine hold finite values only
    finite = F.when(F.abs("_v") < _INF, F.col("_v"))
    stats = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"),
        F.count_if(F.col("_v") == -_INF).alias("_under"), F.count(finite).alias("_finite")).where(F.col("_n") > 0)
    stats = materialize(stats, "quantile-stats")
    big_groups = stats.where(F.col("_n") > limit)
    qarr = F.array(*[F.lit(float(q)) for q in qs])

    def bounded(frame: DataFrame) -> DataFrame:
        # every group of ``frame`` holds at most ``limit`` values: Spark's
        # exact percentile buffers at most that many per group
        agg = (frame.groupBy(*by) if by else frame).agg(F.percentile("_v", qarr).alias("_p"))
        return agg.select(*by, F.posexplode("_p").alias("_qi", value)).select(
            *by, F.element_at(qarr, F.col("_qi") + 1).alias("q"), value)

    if big_groups.isEmpty():
        return bounded(base)
    small = None
    if by:
        small_keys = stats.where(F.col("_n") <= limit).select(*by)
        small = bounded(cell_join(base, small_keys, by, "left_semi"))
        base = cell_join(base, big_groups.select(*by), by, "left_semi")
    stats = big_groups
    t = (stats.select("*", F.posexplode(qarr).alias("_qi", "_q"))
         .withColumn("_pos", (F.col("_n") - 1) * F.col("_q"))
         .withColumn("_which", F.explode(F.array(F.lit(0), F.lit(1))))
         .withColumn("_rank", F.when(F.col("_which") == 0, F.floor("_pos")).otherwise(F.ceil("_pos")))
         .withColumn("_beyond", F.when(F.col("_rank") < F.col("_under"), -_INF)
                     .when(F.col("_rank") >= F.col("_under") + F.col("_finite"), _INF))
         .select(*by, "_qi", "_q", "_pos", "_which", "_rank",
                 F.coalesce("_beyond", "_lo").alias("lo"), F.coalesce("_beyond", "_hi").alias("hi"),
                 F.col("_under").alias("below"), F.col("_finite").alias("cnt")))
    t = materialize(t, "quantile-targets")
    keys, span = [*by, "_qi", "_which"], [*by, "lo", "hi"]

    before = math.inf
    while True:
        big = t.where((F.col("cnt") > limit) & (F.col("hi") > F.col("lo")))
        left = big.agg(F.sum("cnt")).first()[0]
        if left is None:
            break
        if left >= before:
            raise ArithmeticError(f"values of {value} cannot be told apart by their distance")
        before = left
        j = _attach(base, big, by)
        # halves, as a difference of two finite numbers can be infinite
        width = F.col("hi") / 2 - F.col("lo") / 2
        share = F.try_divide(F.col("_v") / 2 - F.col("lo") / 2, width)
        bkt = F.when(F.col("_v") == F.col("hi"), buckets - 1).otherwise(
            F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1)))
        h = j.groupBy(*span, bkt.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax"))
        w = Window.partitionBy(*span).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        h = h.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        local = F.col("_rank") - F.col("below")
        pick = big.join(h, span).where((F.col("_before") <= local) & (local < F.col("_before") + F.col("_c")))
        upd = pick.select(*keys, F.col("_bmin").alias("n_lo"), F.col("_bmax").alias("n_hi"),
                          (F.col("below") + F.col("_before")).alias("n_below"), F.col("_c").alias("n_cnt"))
        t = t.join(upd, keys, "left").select(
            *by, "_qi", "_q", "_pos", "_which", "_rank",
            F.coalesce("n_lo", "lo").alias("lo"), F.coalesce("n_hi", "hi").alias("hi"),
            F.coalesce("n_below", "below").alias("below"), F.coalesce("n_cnt", "cnt").alias("cnt"))
        t = materialize(t, "quantile-targets")

    # final pass: rank only inside each target's bounded range; a range that
    # collapsed to one value is that value
    narrow = t.where(F.col("hi") > F.col("lo"))
    j = _attach(base, narrow, by)
    rk = j.withColumn("_r", F.row_number().over(Window.partitionBy(*span).orderBy("_v")) - 1)
    picked = (narrow.withColumn("_r", F.col("_rank") - F.col("below")).join(rk, [*span, "_r"])
              .select(*keys, F.col("_v").alias("_val")))
    vals = t.join(picked, keys, "left").select(
        *keys, "_q", "_pos", F.when(F.col("hi") > F.col("lo"), F.col("_val")).otherwise(F.col("lo")).alias("_val"))
    lo_v = vals.where(F.col("_which") == 0).select(*by, "_qi", "_q", "_pos", F.col("_val").alias("_a"))
    hi_v = vals.where(F.col("_which") == 1).select(*by, "_qi", F.col("_val").alias("_b"))
    refined = lo_v.join(hi_v, [*by, "_qi"]).select(
        *by, F.col("_q").alias("q"),
        F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
            (F.ceil("_pos") - F.col("_pos")) * F.col("_a") + (F.col("_pos") - F.floor("_pos")) * F.col("_b"))
        .alias(value))
    return refined if small is None else small.unionByName(refined)


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (), **kw) -> DataFrame:
    return exact_quantiles(df, value, [0.5], by, **kw).drop("q")


def global_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], **kw) -> dict:
    """Exact quantiles of several columns of one table: {(col, q): value}.
    The columns are unpivoted into one (column, value) table, so all of
    them are refined in the same passes."""
    if not cols:
        return {}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(f"`{c}`").cast("double")
                                                 .alias("_val")) for c in cols])))
    res = exact_quantiles(long, "_val", qs, ["_col"], **kw).collect()
    return {(r["_col"], r["q"]): r["_val"] for r in res}
