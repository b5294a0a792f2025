"""Each phrase is given out by text from one span of ids, not by every task that meets it."""

from pyspark.sql import functions as F

from regionlens.llm import collocations


def test_one_text_a_phrase(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SPAN", 1)
    docs = spark.range(0, 400, 1, 8).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"),
                                            F.lit("big cat sat").alias("text"))
    plain, made = type(docs).mapInArrow, []

    def spy(self, func, schema, *args, **more):
        out = plain(self, func, schema, *args, **more)
        if "phrase" in str(schema):
            made.append(out)
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", spy)
    phrases, _ = collocations.frequent_phrases(docs, 100, 3, 8)
    assert {(r.phrase, r.f) for r in phrases.collect()} == {
        (p, 400) for p in ("big", "cat", "sat", "big cat", "cat sat", "big cat sat")}
    assert [m.count() for m in made] == [6]   # 48 with a row from each of the 8 tasks


def test_null_and_repeated_ids(spark):
    rows = [(None, "en", "big cat")] * 30 + [(7, "en", "cat sat")] * 30 + [(-5, "und", "cat sat")] * 20 + [(2**62, "en", "cat sat")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    phrases, _ = collocations.frequent_phrases(docs, 20, 2, 8)
    assert sorted((r.lang, r.phrase, r.f) for r in phrases.collect()) == [
        ("en", "big", 30), ("en", "big cat", 30), ("en", "cat", 61), ("en", "cat sat", 31), ("en", "sat", 31),
        ("und", "cat", 20), ("und", "cat sat", 20), ("und", "sat", 20)]
