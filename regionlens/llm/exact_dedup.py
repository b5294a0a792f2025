"""Exact dedup over a persistent digest index (DataFrame functions only).

The index is a table at a path of its own, bucketed and sorted by digest, with one row per distinct
text: ``digest`` and ``keep_id``, the id of the document that stays for it.  A new batch
is reduced to one row per digest (partial aggregation, so a text with a third of all
rows costs one row per task), anti-joined against the index by sort-merge without moving
the index, and appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import fresh, stored

SPACES = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the UTF-8 text with each white-space run as one space; null as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ").cast("binary"), 256))


class DigestIndex:
    """The persistent index.  ``buckets`` should give files of some 100 MB at the final size."""

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Append the batch's new digests; its rows (doc_id, digest), and one row per digest of the
        batch: keep_id, group_size, and n_keep, the batch's rows with that id and text."""
        seen = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                  digest(F.col("text")).alias("digest")), "digests")
        # partial sums per id first: neither a hot text nor a hot id comes to one task as rows
        per_id = seen.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
        groups = stored(per_id.groupBy("digest").agg(
            F.min("doc_id").alias("first_id"), F.sum("n").alias("group_size"),
            F.min_by("n", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("n_first")), "groups")
        # only the batch moves, to the index's buckets; each task then appends to one bucket
        new = groups.repartition(self.buckets, "digest").join(self.rows().hint("merge"), "digest", "left_anti")
        new.select("digest", F.col("first_id").alias("keep_id")).write.insertInto(self.table)
        held = groups.join(self.rows(), "digest").select(
            "digest", "keep_id", "group_size",
            F.when(F.col("first_id").eqNullSafe(F.col("keep_id")), F.col("n_first")).otherwise(0).alias("n_keep"))
        return seen, stored(held, "held")

    def assign(self, docs: DataFrame) -> DataFrame:
        """Deduplicate a batch against the index and itself, and append its new digests.

        Returns doc_id, digest, keep_id, group_size (rows of this batch with that text) and
        kept for each row of ``docs``.  The row with the smallest doc_id stays; a null id
        counts as the largest, and keep_id is null only if every id of the group is null.
        Rows that repeat both id and text all say the same; `unique_rows` leaves one.
        A text that the index knew from before is kept only in the document that stands
        in the index, so adding a batch again, as after a failed job, changes nothing.
        An empty batch gives no rows and leaves the index as it is.
        """
        seen, held = self._add(docs)
        # plain shuffles on both sides, so that a hot digest's rows can be split
        return seen.join(held, "digest").select("doc_id", "digest", "keep_id", "group_size",
                                                F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def unique_rows(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others.

    Of rows that repeat one id and one text, the one whose columns come first as JSON stays.
    """
    d, i, n = (fresh(docs, c) for c in ("_digest", "_keep_id", "_copies"))
    _, held = index._add(docs)
    keep = held.where("n_keep > 0").select(F.col("digest").alias(d), F.col("keep_id").alias(i),
                                           F.col("n_keep").alias(n))
    marked = docs.withColumn(fresh(docs, "_own"), digest(F.col("text")))
    own = marked.columns[-1]
    found = marked.join(keep, (F.col(own) == F.col(d)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(i)))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    single = found.where(F.col(n) == 1).select(*cols)
    packed = F.struct(*cols)
    several = (found.where(F.col(n) > 1).groupBy(d)
               .agg(F.min_by(packed, F.sha2(F.to_json(packed), 256)).alias("row")).select("row.*"))
    return single.unionByName(several)
