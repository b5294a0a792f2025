"""Quality by importance resampling.

Two generative models of hashed n-grams (tokens and pairs of tokens) are counted: one
over texts labelled good, the target, and one over the whole raw corpus.  A document's
weight is the mean log ratio of the two over its n-grams, times ``strength``, so that
long documents do not win by length.  The k largest sums of weight and Gumbel noise are
a sample without replacement in proportion to exp(weight).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import labelled_sample, stored

BUCKETS = 1 << 16


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every token and pair of tokens: words, and runs of other visible characters."""
    rows, words = tx.word_hashes(data, offsets, tx.CLASSES)
    at, pairs = tx.shingles(rows, words, 2)
    buckets = np.concatenate([words, pairs]) >> np.uint64(48)
    return np.concatenate([rows, rows[at]]), buckets.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = tx.buffers(batch.column("text"))
        for a, b in tx.blocks(offsets):
            sums += np.bincount(_grams(data, offsets[a:b + 1])[1], minlength=BUCKETS)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts per bucket over all rows; the driver receives one number per bucket."""
    got = (texts.select("text").mapInArrow(_count, "bucket int, n bigint").groupBy("bucket")
           .agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(BUCKETS)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


@dataclass
class Ratio:
    """log p_target - log p_raw for each bucket."""

    log_ratio: np.ndarray


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, bound: int = 20_000,
          smoothing: float = 20.0) -> Ratio:
    """Count the raw model on all of ``docs`` and the target on the good ones (``quality`` 1) of at
    most ``bound`` labelled documents, of which an id that several rows repeat is one.

    The target is smoothed towards the raw model by ``smoothing`` expected counts a bucket.
    Without labelled good texts every ratio is one.
    """
    raw = gram_counts(docs) + 1.0
    p = raw / raw.sum()
    sample = labelled_sample(docs.sparkSession, docs, labels, "quality", bound, train_rows)
    target = gram_counts(sample.where("y = 1"))
    prior = smoothing * BUCKETS * p
    q = (target + prior) / (target.sum() + prior.sum())
    return Ratio(np.log(q) - np.log(p))


def weight_column(text: Column, ratio: Ratio) -> Column:
    """Mean log ratio over the n-grams of each whole text; 0 for texts without words, null included."""
    log_ratio = ratio.log_ratio

    @F.arrow_udf("double")
    def weight(texts: pa.Array) -> pa.Array:
        data, offsets = tx.buffers(texts)
        out = np.zeros(len(texts))
        for a, b in tx.blocks(offsets):
            rows, buckets = _grams(data, offsets[a:b + 1])
            n = np.bincount(rows, minlength=b - a)
            out[a:b] = np.bincount(rows, weights=log_ratio[buckets], minlength=b - a) / np.maximum(n, 1)
        return pa.array(out)

    return weight(text)


def _kth_largest(table: DataFrame, k: int) -> int | None:
    """The k-th largest of the 64-bit ``key``, by four rounds of counts over 16 bits each."""
    if k <= 0:
        return None
    prefix, rest = None, k
    for shift in (48, 32, 16, 0):
        part = table if prefix is None else table.where(F.shiftright("key", shift + 16) == prefix)
        counts = part.groupBy(F.shiftright("key", shift).alias("p")).count().orderBy(F.desc("p")).collect()
        for p, n in counts:
            if rest <= n:
                prefix = p
                break
            rest -= n
        else:
            return None
    return prefix


def resample(docs: DataFrame, ratio: Ratio, fraction: float, strength: float = 64.0, seed: int = 42) -> DataFrame:
    """doc_id, weight, key and selected for each row: the top ``fraction`` of all rows by weight plus
    Gumbel noise, exactly round(fraction N) of them.

    weight is ``strength`` times the mean log ratio.  The noise is a hash of id and text,
    so rows that repeat one id and text have equal keys; if the cut falls among them, as
    many as are missing are taken in the order in which they were stored.  Texts without words have weight 0 and are not selected
    before any other row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    weighed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), weight_column(F.col("text"), ratio).alias("mean"),
                          (~text.rlike(r"[^\x00-\x20\x7F]")).alias("empty"),
                          F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(text.cast("binary"))).alias("h"))
    unit = (F.shiftrightunsigned("h", 11) + 0.5) / float(1 << 53)
    noisy = weighed.withColumn("weight", F.col("mean") * strength).withColumn(
        "noisy", F.when(F.col("empty"), F.lit(-1e6)).otherwise(F.col("weight") - F.log(-F.log(unit))))
    # 2^-24 steps in the upper bits, the hash below: an order without ties but of repeats
    steps = F.round(F.greatest(F.least(F.col("noisy"), F.lit(1e5)), F.lit(-1e5)) * 8192).cast("bigint")
    key = F.call_function("shiftleft", steps, F.lit(32)) + F.shiftrightunsigned("h", 32)
    table = stored(noisy.select("doc_id", "weight", key.alias("key"), F.monotonically_increasing_id().alias("nth")),
                   "resample")
    k = round(fraction * table.count())
    cut, chosen = _kth_largest(table, k), F.lit(False)
    if cut is not None:
        over = F.col("key") > cut
        tied = table.where(F.col("key") == cut)
        last = _kth_largest(tied.select((-F.col("nth")).alias("key")), k - table.where(over).count())
        chosen = over | ((F.col("key") == cut) & (-F.col("nth") >= last))
    return table.select("doc_id", "weight", "key", chosen.alias("selected"))
