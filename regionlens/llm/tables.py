"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.session import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage is cut,
    the rows are fixed, and no executor has to live on for them."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str,
                    bound: int, train: Column) -> DataFrame:
    """Texts of at most ``bound`` labelled ids (doc_id, y, text), one row each, stored.

    The ids are those with the smallest hash among the rows of ``labels`` for which
    ``train`` (over doc_id) holds and the label is not null; several labels of one id
    count as the largest.  Only these ids, at most ``bound`` pairs of numbers, are
    broadcast.  Of the rows that repeat an id, the one whose text has the smallest hash is taken.
    """
    ids = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
           .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & train)
           .groupBy("doc_id").agg(F.max("y").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    return stored(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(least["text"].alias("text")), "sample")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
