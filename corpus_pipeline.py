"""The corpus pipeline: five stages, each over all documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.llm import decontaminate, exact_dedup, pieces, queries, simhash, toxicity
from regionlens.llm.tables import documents, fold, read_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine scores below a half; it learns from the labelled ones of ``docs``."""
    machine = toxicity.train(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 0)
    return docs.where(toxicity.score_column(F.col("text"), machine) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.unique_rows(docs, queries.new_index(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints at up to 3 bits."""
    return simhash.one_of_each(docs, words=3, distance=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark passage to a half or more."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number, and the text that the ids decode to."""
    model = pieces.read_model(queries.tokenizer_path())
    both = docs.select("doc_id", pieces.round_trip_column(F.col("text"), model).alias("t"))
    return both.select("doc_id", F.size("t.ids").cast("bigint").alias("n_tokens"), "t.ids", "t.decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: The first stage learns its model and the third hashes with XXH64, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents: token ids of each document that every filter keeps.

    A null text counts as empty in every stage; a null id is an id like any other in the
    filters, never labelled, and stays null in the result.  Of equal or near-equal rows one
    stays.  An empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
