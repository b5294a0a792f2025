"""SimHash near-dedup by multi-index hashing.

Fingerprints differ in at most 3 bits only if they differ in at most 1 bit in one of
their two 32-bit halves.  Every distinct fingerprint is therefore entered in a table
under each half; as a query it asks for each half itself and for the half with one of
its zero bits set (the small Hamming ball; the partner that lacks the set bit asks, so
each pair at distance one is found from one side).  Matches are kept only if the
complete 64-bit distance holds.  Copies collapse to one fingerprint before any of this.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .tables import fresh, stored

STEP = 1 << 15


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text: XXH64 (seed 42) of its lower-cased word shingles."""
    parts = text.lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], ends[:n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    votes = np.zeros(64, np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        h = np.fromiter((hash64(flat[a:b], 42) for a, b in zip(starts[at:at + STEP], stops[at:at + STEP])),
                        np.uint64, min(STEP, n - at))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed 64-bit number; null text counts as empty."""
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("").cast(pa.large_binary())
        own = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
        return pa.array(own.view(np.int64))

    return run(text)


def linked_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of ``fp`` within ``distance`` (at most 3) bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of one bit find up to 3 differing bits")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    keys = F.array(high, low.bitwiseOR(F.lit(1 << 32)))  # bit 32 tells the halves apart
    table = prints.select(F.explode(keys).alias("key"), F.col("fp").alias("b"))
    half = F.explode(keys).alias("own")
    bits = F.expr("filter(sequence(0, 31), i -> (shiftright(own, i) & 1L) = 0L)")
    ball = F.concat(F.array("own"), F.transform(bits, lambda i: F.col("own").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    asked = (prints.select("fp", half).select(F.col("fp").alias("a"), "own", F.explode(ball).alias("key"))
             .withColumn("exact", F.col("own") == F.col("key")).drop("own"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # equal halves are met from both sides: one is enough; merged, as Spark's estimate of either
    # side misses the exploded rows and would broadcast all of them
    found = asked.join(table.hint("merge"), (asked["key"] == table["key"]) & near
                       & (~F.col("exact") | (F.col("a") < F.col("b"))))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(prints: DataFrame, first: Column, distance: int) -> DataFrame:
    """(fp, root, first) for each distinct ``fp``; linked fingerprints share a root."""
    distinct = stored(prints.groupBy("fp").agg(first.alias("first")), "fps")
    edges = stored(linked_pairs(distinct.select("fp"), distance), "links")
    # (node, root) for linked fingerprints only; a lone one is its own component
    roots = connected(edges)
    return (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("root", "fp").alias("root"), "first"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """For each row of ``docs``: doc_id, fp and component_id.

    component_id is the smallest doc_id that links of at most ``distance`` bits reach,
    the row's own included.  Null texts count as empty; texts without words have
    fingerprint zero, linked like any other.  Null ids are passed over in the minimum
    (component_id is null if a component has no other).  An empty table gives no rows.
    """
    prints = stored(docs.select(F.col("doc_id"), fingerprint_column(F.col("text"), words).alias("fp")), "fp")
    by_print = _rooted(prints, F.min("doc_id"), distance)
    least = by_print.groupBy("root").agg(F.min("first").alias("component_id"))
    component = stored(by_print.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(component, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component of ``docs``, with all its columns and no others.

    The row with the smallest (doc_id, text hash) stays; a null id counts as the largest.
    Of rows that repeat both, the one whose columns come first by the hash of their JSON.
    """
    i, h, n = (fresh(docs, c) for c in ("_first_id", "_first_hash", "_copies"))
    own = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    prints = docs.select("doc_id", own.alias("hash"), fingerprint_column(F.col("text"), words).alias("fp"))
    # partial sums per id and text first: no hot id or print comes to one task as rows
    counts = prints.groupBy("fp", "doc_id", "hash").agg(F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "n")
    first = _rooted(counts, F.min(place), distance).groupBy("root").agg(F.min("first").alias("first"))
    keep = stored(first.select(F.col("first.doc_id").alias(i), F.col("first.hash").alias(h),
                               F.col("first.n").alias(n)), "first")
    found = docs.join(keep, (own == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(i)))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    single = found.where(F.col(n) == 1).select(*cols)
    packed = F.struct(*cols)
    several = (found.where(F.col(n) > 1).groupBy(h, i)
               .agg(F.min_by(packed, F.sha2(F.to_json(packed), 256)).alias("row")).select("row.*"))
    return single.unionByName(several)
