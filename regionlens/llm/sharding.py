"""Contiguous shards of near-equal bytes from global prefix sums (DataFrame functions only).

Rows are put in one global order by range partitioning, each partition adds up its own
sizes, and the partition totals (one row per partition) give every row its place in
the corpus.  Cuts at equal targets then need no further movement of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored


def balanced_shards(docs: DataFrame, shards: int, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of ``docs``.

    size: UTF-8 bytes of the text (null: none) plus ``overhead``.  Rows are ordered by
    doc_id (nulls first), then text_crc32, then size; rows equal in all three are
    interchangeable.  A row goes to the shard that holds the middle of its bytes when
    the total is cut into ``shards`` equal parts, so a shard's size is off by less than
    one row at each end; a row longer than a part leaves shards empty.  slot counts the
    rows of a shard from 0 in that order.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sizes = stored(docs.select("doc_id", (F.octet_length(text) + overhead).cast("bigint").alias("size"),
                               F.crc32(text).alias("text_crc32"))
                   # a tie-breaker, so that rows that repeat one id can be cut apart
                   .withColumn("nth", F.monotonically_increasing_id()), "sizes")
    order = ["doc_id", "text_crc32", "size", "nth"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # written once: the bounds are drawn from a sample, and a second run could draw others
    ranged = stored(sizes.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    within = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row per partition, a number the session sets
    over = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = totals.select("part", (F.sum("bytes").over(over) - F.col("bytes")).alias("bytes_before"),
                           (F.sum("rows").over(over) - F.col("rows")).alias("rows_before"),
                           F.sum("bytes").over(every).alias("total"))
    placed = (ranged.withColumn("upto", F.sum("size").over(within)).withColumn("row", F.row_number().over(
        W.partitionBy("part").orderBy(*order)))
        .join(F.broadcast(starts), "part"))
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    cut = F.floor(middle.cast("decimal(38,0)") * shards / (2 * F.col("total")).cast("decimal(38,0)"))
    out = stored(placed.select("doc_id", "size", "text_crc32", cut.cast("int").alias("shard"),
                               (F.col("rows_before") + F.col("row") - 1).alias("place")), "placed")
    # at most one row per shard
    first = out.groupBy("shard").agg(F.min("place").alias("first"))
    return out.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
