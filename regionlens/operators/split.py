"""Validation splits and masks (W3-W7, P10), reproducible across
partitionings because every random choice is a hash of (key, seed).

Exact-size selections ("the n*frac rows with the smallest hash") find the
k-th smallest hash and compare every row with that literal: no sort of the
table, no window and no join.  Rows that repeat a key share its hash and are
told apart by a hash of the row; copies of one row, only where a boundary
falls among them, by a number written once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionlens.operators.spatial import row_hash

_PREFIX_HEX = 4                      # 16 bits of hash per refinement level
_FETCH_BELOW = 10_000                # hashes of a boundary bucket fetched at once
_DIGITS = 32 + 16                    # md5 of the key, then the row hash


def hash_score(key, seed: int | str, salt: str = "") -> Column:
    """md5 of ``key || '#' || salt || seed`` as a lowercase hex string
    (identical in Spark and DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"#{salt}{seed}")))


def _digits(df: DataFrame, score: Column) -> Column:
    """The order of selection as hex text of fixed length: score, then row
    hash; a NULL score (NULL key) comes first."""
    return F.concat(F.coalesce(score, F.lit("0" * 32)), F.lpad(F.lower(F.hex(row_hash(df))), 16, "0"))


def _kth_smallest(digits: DataFrame, k: int, size: int | None = None) -> tuple[str | None, int, int]:
    """`_kth_smallest_each` of the one column ``d``."""
    return _kth_smallest_each(digits.select(F.lit("").alias("c"), "d"), [""], k, size)[""]


def _kth_smallest_each(digits: DataFrame, names: Sequence[str], k: int, size: int | None = None
                       ) -> dict[str, tuple[str | None, int, int]]:
    """For each name in column ``c``, the ``k``-th smallest value of ``d`` (None: take no row), how
    many rows with that value are among the ``k``, and how many there are.  Every name
    has ``size`` rows (counted if not given).

    Level by level, counts by the next 4 hex digits (at most 65,536 rows a name)
    locate the bucket that holds the k-th row, until that bucket is small
    enough to fetch or its rows are equal in all digits.  All names share
    each pass and the one fetch at the end.
    """
    if k <= 0:
        return dict.fromkeys(names, (None, 0, 0))
    if size is None:
        size = digits.where(F.col("c") == names[0]).count()
    if k >= size:
        return dict.fromkeys(names, ("~", 0, 0))             # above all hex digits
    prefix, need, sizes = dict.fromkeys(names, ""), dict.fromkeys(names, k), dict.fromkeys(names, size)

    def inside(wanted):
        return digits.where(reduce(or_, [(F.col("c") == c) & F.col("d").startswith(prefix[c]) for c in wanted]))

    while wide := [c for c in names if sizes[c] > _FETCH_BELOW and len(prefix[c]) < _DIGITS]:
        start = len(prefix[wide[0]]) + 1                     # they have all come equally far
        counts = sorted((r["c"], r["b"], r["n"]) for r in inside(wide)
                        .groupBy("c", F.substring("d", start, _PREFIX_HEX).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        for c in wide:
            for _, b, n in (r for r in counts if r[0] == c):
                if need[c] <= n:
                    break
                need[c] -= n
            prefix[c], sizes[c] = prefix[c] + b, n
    out = {c: (prefix[c], need[c], sizes[c]) for c in names if len(prefix[c]) >= _DIGITS}
    if rest := [c for c in names if c not in out]:
        rows = inside(rest).collect()
        for c in rest:
            found = sorted(r["d"] for r in rows if r["c"] == c)
            bound = found[need[c] - 1]
            out[c] = bound, need[c] - found.index(bound), found.count(bound)
    return out


def _number_copies(df: DataFrame, split: Column) -> tuple[DataFrame, str]:
    """``df`` with a column that numbers its rows for which ``split`` holds, and its
    name.  These rows alone are written, so that their numbers are fixed."""
    from regionlens.session import materialize

    n = "_copy"
    while n.lower() in {c.lower() for c in df.columns}:
        n += "_"
    split = F.coalesce(split, F.lit(False))
    copies = materialize(df.where(split).withColumn(n, F.monotonically_increasing_id()), "copies")
    return df.where(~split).withColumn(n, F.lit(None).cast("bigint")).unionByName(copies), n


def _kth_copy(numbered: DataFrame, group: Column, n: str, k: int) -> int:
    """The ``k``-th smallest number among the rows of ``group``."""
    digits = numbered.where(group & F.col(n).isNotNull()).select(F.lpad(F.lower(F.hex(n)), _DIGITS, "0").alias("d"))
    n = digits.count()
    if n <= k:
        return (1 << 63) - 1
    return int(_kth_smallest(digits, k, n)[0], 16)


def smallest_k_flag(df: DataFrame, score: Column, k: int, flag: str = "selected", size: int | None = None) -> DataFrame:
    """Flag the ``k`` of ``size`` rows with the smallest (score, row hash).  Of copies (rows equal
    in all columns but maps) on the boundary, any that make up ``k`` are flagged."""
    d = _digits(df, score)
    bound, need, size = _kth_smallest(df.select(d.alias("d")), k, size)
    if need == size:
        return df.withColumn(flag, F.lit(False) if bound is None else d <= F.lit(bound))
    numbered, n = _number_copies(df, d == F.lit(bound))
    last = _kth_copy(numbered, d == F.lit(bound), n, need)
    return numbered.withColumn(flag, (d < F.lit(bound)) | ((d == F.lit(bound)) & (F.col(n) <= last))).drop(n)


def exact_split(df: DataFrame, key: str, test_frac: float = 0.2, seed: int = 42,
                flag: str = "is_test") -> DataFrame:
    """W3 exact-size random split: the ``ceil(n * frac)`` rows with the
    smallest md5(key, seed) are the test set (sklearn's test-size rule)."""
    n = df.count()
    return smallest_k_flag(df, hash_score(key, seed), int(math.ceil(n * test_frac)), flag, n)


def hash_split(df: DataFrame, key: str, test_frac: float = 0.2, seed: int = 42,
               flag: str = "is_test") -> DataFrame:
    """W4 approximate split for large n: threshold on the hash, no sort and
    no count; stable under any partitioning."""
    h = F.conv(F.substring(hash_score(key, seed), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    return df.withColumn(flag, h < test_frac)


def contiguous_folds(df: DataFrame, order: str, k: int = 5, fold: str = "fold") -> DataFrame:
    """W6 unshuffled k-fold: consecutive blocks in key order, the first
    ``n mod k`` folds one row larger (KFold / ntile rule).

    The first rows of folds 1 to k-1 are found at their exact ranks; a row's
    fold is then the number of them that it does not precede, so nothing
    depends on how the table is partitioned.  Ties on the key go by a hash of
    the row, NULL keys come first; of copies (rows equal in all columns but maps)
    on both sides of a border, any that make up a fold's size go to it.
    """
    place = F.struct(F.col(order).alias("o"), row_hash(df).alias("h"))
    kind = df.schema[order].dataType
    firsts = [(F.struct(F.lit(o).cast(kind).alias("o"), F.lit(h).cast("bigint").alias("h")), skip)
              for o, h, skip in _first_rows(df.select(place["o"].alias("o"), place["h"].alias("h")), k)]
    numbered, n = df, None
    split = [place == first for first, skip in firsts if skip]
    if split:
        numbered, n = _number_copies(df, reduce(or_, split))
    out = F.lit(0)
    for first, skip in firsts:
        here = place >= first
        if skip:
            here = (place > first) | ((place == first) & (F.col(n) > _kth_copy(numbered, place == first, n, skip)))
        out = out + F.when(here, 1).otherwise(0)
    numbered = numbered.withColumn(fold, out.cast("int"))
    return numbered.drop(n) if n else numbered


def _first_rows(keys: DataFrame, k: int) -> list[tuple]:
    """(o, h) of the first row of each fold but 0, at most k - 1 of them, and how
    many rows with the same (o, h) come before it.

    The keys alone are range-partitioned and written once (the bounds are
    drawn from a sample, so a second run could draw others); one count per
    partition then tells which rows have the wanted ranks.
    """
    from regionlens.session import materialize

    spark = keys.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "1")))
    ranged = materialize(keys.repartitionByRange(parts, "o", "h").withColumn("p", F.spark_partition_id()), "ranged")
    counts = sorted((r["p"], r["n"]) for r in ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in counts)
    size, big = divmod(n, k)
    ranks = {f * size + min(f, big) for f in range(1, k)} - {0, n}
    wanted, before = [], 0
    for p, c in counts:
        wanted += [(p, r - before + 1) for r in sorted(ranks) if before <= r < before + c]
        before += c
    if not wanted:
        return []
    hit = F.lit(False)
    for p, r in wanted:
        hit = hit | ((F.col("p") == p) & (F.col("r") == r))
    rows = (ranged.where(F.col("p").isin([p for p, _ in wanted]))
            .withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("o", "h")))
            # equal rows are in one partition, so their first place there tells how many come before
            .withColumn("s", F.rank().over(Window.partitionBy("p").orderBy("o", "h"))).where(hit).collect())
    return sorted(((r["o"], r["h"], r["r"] - r["s"]) for r in rows), key=lambda x: (x[0] is not None, x))


def group_folds(df: DataFrame, group: str, k: int = 5, fold: str = "fold") -> DataFrame:
    """W5 grouped k-fold: whole groups stay in one fold; groups, largest
    first (ties by group id), go to the currently lightest fold (ties to the
    lowest fold number).  NULL is a group too.

    The driver sees only how many groups have each size.  Groups of one size
    n fill the slots (load of fold f + t * n, f), t = 0, 1, ... in their
    order, so how many each fold takes and which rank each slot has follow by
    arithmetic; slots and ranked groups then meet in an equi-join.
    """
    from regionlens.operators.spatial import broadcast_if_small
    from regionlens.session import materialize

    spark = df.sparkSession
    counts = (df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_s", F.col("_g").cast("string")))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "1")))
    ranged = materialize(counts.repartitionByRange(parts, F.desc("_n"), F.asc("_s"))
                         .withColumn("_p", F.spark_partition_id()), "groups")
    offsets, before = [], 0
    for p, c in sorted((r["_p"], r["c"]) for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).collect()):
        offsets.append((p, before))
        before += c
    sizes = sorted(((r["_n"], r["c"]) for r in ranged.groupBy("_n").agg(F.count(F.lit(1)).alias("c")).collect()),
                   reverse=True)
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("_n"), F.asc("_s"))) - 1
    ranked = (ranged.withColumn("_i", place)
              .join(F.broadcast(spark.createDataFrame(offsets, "_p int, _o bigint")), "_p")
              .select("_g", (F.col("_i") + F.col("_o")).alias("_r")))
    table = materialize(ranked.join(_fold_slots(spark, sizes, k), "_r").select("_g", F.col("_f").alias(fold)),
                        "group-folds")
    table = broadcast_if_small(table)
    return df.join(table, df[group].eqNullSafe(table["_g"]), "left").drop("_g")


def _fold_shares(loads: Sequence[int], n: int, m: int) -> list[int]:
    """How many of ``m`` groups of size ``n`` each fold takes, each going to the lightest fold."""
    def below(level):
        return [max(0, -(-(level - x) // n)) for x in loads]

    low, high = min(loads), max(loads) + n * m + 1
    while high - low > 1:            # the highest level below which there are at most m slots
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= m else (low, mid)
    out = below(low)
    rest = m - sum(out)
    for f, x in enumerate(loads):    # slots at the level itself go by fold number
        if rest and x + out[f] * n == low:
            out[f] += 1
            rest -= 1
    return out


def _fold_slots(spark: SparkSession, sizes: Sequence[tuple[int, int]], k: int) -> DataFrame:
    """(_r, _f): the fold of the group with rank ``_r``, for all ranks."""
    run = 1 << 16                    # slots that one row stands for before they are spread
    loads, start, rows = [0] * k, 0, []
    for n, m in sizes:
        shares = _fold_shares(loads, n, m)
        rows += [(n, start, f, c, loads, shares) for f, c in enumerate(shares) if c]
        loads, start = [x + n * c for x, c in zip(loads, shares)], start + m
    taken = " + ".join(
        f"CASE WHEN _f = {g} THEN t ELSE least(shares[{g}], greatest(0L, "
        f"(loads[_f] + t * n + CASE WHEN {g} < _f THEN 1 ELSE 0 END - loads[{g}] + n - 1) div n)) END"
        for g in range(k))
    return (spark.createDataFrame(rows, "n bigint, start bigint, _f int, c bigint, loads array<bigint>, shares array<bigint>")
            .withColumn("t0", F.explode(F.expr(f"sequence(0L, c - 1, {run}L)")))
            .repartition("start", "_f", "t0")
            .withColumn("t", F.explode(F.expr(f"sequence(t0, least(t0 + {run}L, c) - 1)")))
            .select((F.col("start") + F.expr(taken)).alias("_r"), "_f"))


def mask_cells(df: DataFrame, key: str, cols: Sequence[str], frac: float, seed: int = 42) -> DataFrame:
    """W7 set exactly ``int(n * frac)`` values of each column to NULL, the
    rows chosen per column by md5(key, column, seed); all columns share the
    passes that find their thresholds.  The masked table is
    written once to the checkpoint folder: every later pass (NULL counts,
    medians, the model fit) reads it instead of re-ranking."""
    from regionlens.session import materialize

    n_rows = df.count()
    k = int(n_rows * frac)
    if k <= 0 or not cols:
        return df
    orders = {c: _digits(df, hash_score(key, seed, salt=c + "#")) for c in cols}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), d.alias("d")) for c, d in orders.items()])))
    bounds = _kth_smallest_each(long, list(orders), k, n_rows)
    masked, found = {}, {c: (d, *bounds[c]) for c, d in orders.items()}
    split = [d == F.lit(bound) for d, bound, need, size in found.values() if need < size]
    numbered, n = _number_copies(df, reduce(or_, split)) if split else (df, None)
    for c, (d, bound, need, size) in found.items():
        out = d > F.lit(bound)
        if need < size:
            out = out | ((d == F.lit(bound)) & (F.col(n) > _kth_copy(numbered, d == F.lit(bound), n, need)))
        masked[c] = F.when(out, F.col(c))
    return materialize(numbered.select(*[masked.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]), "masked")
