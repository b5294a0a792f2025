"""Importance resampling towards a target distribution.

A feature is a run of consecutive words; its bucket is the CRC32 of its bytes modulo the
number of buckets.  Two arrays of counts, one over the raw corpus and one over the target
texts, give one whole number per bucket, its gain.  A document's weight is the mean gain of
its features; weight plus Gumbel noise from a hash of the id is its score, and the highest
scores are drawn.

The cutoff among the scores is found by weighted median of medians: every task reports the
median of the keys that it still holds and how many there are; the median of these, weighted
by the numbers, has at least a quarter of the remaining keys on either side, so counting the
keys below it rules out a guaranteed share, until it is the cutoff key itself.  Only the
drawn rows are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as tx
from .tables import stored

#: Words up to this many bytes go through the byte table together, longer ones one by one.
SHORT = 32
FULL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def _extend(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each CRC-32 of ``crc`` continued with the bytes ``starts`` to ``ends`` of ``data``."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -SHORT, side="left"))
    out = crc.copy()
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]], int(crc[i]))
    rest = order[long:]
    state, at, size = out[rest] ^ FULL, starts[rest], size[rest]
    active = len(rest)
    for j in range(int(size[0]) if active else 0):
        active = int(np.searchsorted(-size, -j, side="left"))
        part = state[:active]
        state[:active] = CRC[(part ^ data[at[:active] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[rest] = state ^ FULL
    return out


def features(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every run of 1 to ``most`` words of the rows, and each row's words."""
    first = int(offsets[0])
    data, offsets = tx.LOWER[data[first:int(offsets[-1])]], offsets - first
    starts, ends = tx.word_spans(data, tx.IS_ALNUM.astype(np.uint8), offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    at, crc = np.arange(len(starts)), np.zeros(len(starts), np.uint32)
    rows, found = [], []
    for k in range(most):
        if k:
            keep = at + k < len(starts)
            at, crc = at[keep], crc[keep]
            keep = row[at + k] == row[at]
            at, crc = at[keep], crc[keep]
            crc = _extend(crc, np.array([32], np.uint8), np.zeros(len(at), np.int64), np.ones(len(at), np.int64))
        crc = _extend(crc, data, starts[at + k], ends[at + k])
        rows.append(row[at])
        found.append((crc % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found), np.bincount(row, minlength=len(offsets) - 1)


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows of ``texts``; the driver receives one number per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = tx.buffers(batch.column(0))
            for a, b in tx.blocks(offsets):
                sums += np.bincount(features(data, offsets[a:b + 1], most, buckets)[1], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    got = (texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket")
           .agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


@dataclass
class Gains:
    """One whole number per bucket: a thousand times the log ratio of target to raw."""

    gain: np.ndarray
    most: int

    @classmethod
    def of(cls, raw: np.ndarray, target: np.ndarray, most: int) -> Gains:
        """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for B buckets, in doubles."""
        b = len(raw)
        big_s, big_t = float(int(raw.sum()) + b), float(int(target.sum()) + b)
        ratio = [(t + 1.0) * big_s / ((s + 1.0) * big_t) for s, t in zip(raw.tolist(), target.tolist())]
        return cls(np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64), most)


def train(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000) -> Gains:
    """Count both models over all texts; ``docs`` and ``target`` need a column text."""
    return Gains.of(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets), most)


def weight_column(text: Column, gains: Gains) -> Column:
    """n_features, n_words and weight (the floored mean gain; without features 0) of each whole text."""
    gain, most = gains.gain, gains.most

    @F.arrow_udf("struct<n_features: bigint, n_words: bigint, weight: bigint>")
    def weigh(texts: pa.Array) -> pa.Array:
        data, offsets = tx.buffers(texts)
        n, words, sums = (np.zeros(len(texts), np.int64) for _ in range(3))
        for a, b in tx.blocks(offsets):
            rows, found, words[a:b] = features(data, offsets[a:b + 1], most, len(gain))
            n[a:b] = np.bincount(rows, minlength=b - a)
            order = np.argsort(rows, kind="stable")
            total = np.concatenate([[0], np.cumsum(gain[found[order]])])
            ends = np.cumsum(n[a:b])
            sums[a:b] = total[ends] - total[ends - n[a:b]]
        return pa.StructArray.from_arrays([pa.array(n), pa.array(words), pa.array(sums // np.maximum(n, 1))],
                                          names=["n_features", "n_words", "weight"])

    return weigh(text)


# ---------------------------------------------------------------- selection

KEY = ["k1", "k2", "k3"]
_REPORT = "side int, n bigint, k1 bigint, k2 bigint, k3 bigint"


def _key(values: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in zip(KEY, values)])


def _key_in(low: tuple | None, high: tuple | None) -> Column:
    """Rows with a key strictly between the two; the bounds on the first part alone reach the scan."""
    own, inside = F.struct(*KEY), F.lit(True)
    for bound, above in ((low, True), (high, False)):
        if bound is not None:
            there = _key(bound)
            inside = inside & ((own > there) if above else (own < there))
            inside = inside & ((F.col("k1") >= bound[0]) if above else (F.col("k1") <= bound[0]))
    return inside


def _reports(table: DataFrame, pivot: tuple | None) -> list[tuple[int, int, tuple]]:
    """From every task: keys below (0) and above (1) ``pivot``, and the median of each; without pivot all are 0."""
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(b.column(k)) for k in KEY] for b in batches if b.num_rows]
        if not parts:
            return
        keys = [np.concatenate(p) for p in zip(*parts)]
        keys = [k[order] for order in [np.lexsort(keys[::-1])] for k in keys]
        below, above = len(keys[0]), len(keys[0])
        if pivot is not None:
            a, b = 0, len(keys[0])
            for k, p in zip(keys, pivot):
                a, b = a + int(np.searchsorted(k[a:b], p, "left")), a + int(np.searchsorted(k[a:b], p, "right"))
            below, above = a, b
        rows = [(side, y - x, *(int(k[(x + y - 1) // 2]) for k in keys))
                for side, x, y in ((0, 0, below), (1, above, len(keys[0]))) if y > x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.int64()] * 4)],
                                             names=["side", "n", *KEY])

    return [(r.side, r.n, (r.k1, r.k2, r.k3)) for r in table.select(*KEY).mapInArrow(report, _REPORT).collect()]


def kth_key(table: DataFrame, k: int) -> tuple[int, int, int] | None:
    """The k-th smallest key (k1, k2, k3) of ``table``, whose keys are all different; None if it has fewer rows.

    A round is one job; each task holds the keys of its own split and reports two medians,
    so the driver sees two rows a task.  A round leaves three quarters of the keys at most;
    once an eighth of the table is left, that is written anew and read instead.
    """
    low = high = None
    size = table.count()
    if not 0 < k <= size:
        return None
    reports = [(n, key) for _, n, key in _reports(table, None)]
    while True:
        reports.sort(key=lambda r: r[1])
        half, seen = sum(n for n, _ in reports) / 2, 0
        for n, pivot in reports:
            seen += n
            if seen >= half:
                break
        got = _reports(table.where(_key_in(low, high)), pivot)
        below = sum(n for side, n, _ in got if side == 0)
        if k == below + 1:
            return pivot
        side = int(k > below)
        if side:
            low, k = pivot, k - below - 1
        else:
            high = pivot
        reports = [(n, key) for s, n, key in got if s == side]
        left = sum(n for n, _ in reports)
        if left * 8 <= size:
            table, size = stored(table.where(_key_in(low, high)), "keys"), left
            low = high = None


def resample(docs: DataFrame, gains: Gains, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row of ``docs``.

    score is weight + floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of the
    SHA-256 of "seed:doc_id".  Of the N rows with ``least_words`` words or more, the
    floor(``percent`` N / 100) highest scores are drawn; equal scores go to the smaller
    doc_id (null last, hashed as the empty text), and rows that repeat one id and score in
    the order in which they were stored.  rank is 1, 2, 3... in that order and null for rows
    not drawn.  Null texts count as empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), weight_column(F.col("text"), gains).alias("w"),
                                noise.alias("noise"))
                    .select("doc_id", "w.n_features", "w.n_words", "w.weight", (F.col("w.weight") + F.col("noise")).alias("score"),
                            F.monotonically_increasing_id().alias("nth")), "scored")
    keyed = scored.withColumns({"k1": -F.col("score"), "k2": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "k3": F.col("nth")})
    able = F.col("n_words") >= least_words
    table = keyed.where(able)
    cut = kth_key(table, percent * table.count() // 100)
    shown = ["doc_id", "n_features", "weight", "score"]
    drawn = F.lit(False) if cut is None else able & (F.struct(*KEY) <= _key(cut))
    # written once: range bounds come from a sample, and a second run could draw others
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    winners = stored(keyed.where(drawn).repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()), "drawn")
    # one row per partition, a number the session sets
    totals = winners.groupBy("part").count()
    over = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = totals.select("part", (F.sum("count").over(over) - F.col("count")).alias("before"))
    ranked = (winners.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(*KEY)))
              .join(F.broadcast(before), "part")
              .select(*shown, (F.col("before") + F.col("place")).cast("bigint").alias("rank")))
    return ranked.unionByName(keyed.where(~drawn).select(*shown, F.lit(None).cast("bigint").alias("rank")))
