"""Only phrases that stand often enough in the whole corpus are counted by text."""

import numpy as np
from pyspark.sql import functions as F

from regionlens.llm import collocations


def test_candidates_are_frequent_overall(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SPAN", 1)
    bits = []
    plain = collocations._counted

    def spy(docs, most, known):
        bits.append(int(np.unpackbits(known.value).sum()))
        return plain(docs, most, known)

    monkeypatch.setattr(collocations, "_counted", spy)
    # "big cat" stands in every row; each row's own two words stand three times, in one shard
    text = F.concat(F.lit("big cat"), F.repeat(F.concat(F.lit(". p"), "doc_id", F.lit(" q"), "doc_id"), 3))
    docs = spark.range(40).withColumnRenamed("id", "doc_id").select("doc_id", F.lit("en").alias("lang"), text.alias("text"))
    rows = collocations.collocations(docs, 20, 3).collect()
    assert [(r.phrase, r.a) for r in rows] == [("big cat", 40)] and bits == [3]
