"""The registered queries: thin digests of what the operators return for whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.session import checkpoint_dir

from . import (chat, collocations, decontaminate, exact_dedup, importance, lattice, licenses, pieces, pii, quality,
               sharding, simhash, toxicity)
from .tables import documents, fold, read_table, stored

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def new_index(spark: SparkSession) -> exact_dedup.DigestIndex:
    """An empty digest index in the shared folder, for one run."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return exact_dedup.DigestIndex(spark, name, f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}")


def hex_sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup through the digest index: which row of each set of equal texts stays.

    Texts are equal after white space is normalised; a null text counts as empty.  The
    smallest doc_id of equals stays, so a null id stays only beside null ids; rows that repeat
    id and text all carry that id's verdict.  An empty table gives no rows.
    """
    found = new_index(spark).assign(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and the groups that up to 3 differing bits link.

    Texts without words, nulls included, have fingerprint 0 and are linked like any other;
    rows that repeat an id or text are linked through their equal fingerprints.  A null id is
    named as a component only where no other id is reachable.
    """
    found = simhash.near_duplicates(documents(spark, sf_dir), words=3, distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each whole text by the prefix table, and what they decode to.

    A null text counts as empty: no tokens, and the digests of the empty text.  Every row is
    treated by itself, so repeated ids and rows each have their own.
    """
    model = pieces.read_model(tokenizer_path())
    both = (documents(spark, sf_dir)
            .select("doc_id", pieces.round_trip_column(F.col("text"), model).alias("t")).select("doc_id", "t.*"))
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       hex_sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                       hex_sha256(F.col("decoded")).alias("decoded_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 contiguous shards of near-equal bytes.

    A null text has no bytes, its row counts 16.  Rows go by doc_id (nulls first), checksum
    and size; rows equal in all three are interchangeable.
    """
    placed = sharding.balanced_shards(documents(spark, sf_dir), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling by hashed n-grams: 80 % of the rows are drawn.

    Texts without words, nulls included, weigh 0 and are drawn last.  Rows that repeat an id
    and text tie; see `quality.resample` for which of them are drawn.
    """
    docs = documents(spark, sf_dir)
    ratio = quality.train(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 0)
    return quality.resample(docs, ratio, fraction=0.8)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and evaluated expressions in each whole text.

    A null text counts as empty: no words, null places, empty lists.  Every row is treated by
    itself, so repeated ids and rows each have their own.
    """
    found = documents(spark, sf_dir).select("doc_id", licenses.scan_column(F.col("text")).alias("s"))
    return found.select("doc_id", "s.n_words", "s.n_base", "s.first_word", "s.last_word",
                        F.array_join("s.base_labels", ",").alias("base_labels"),
                        F.array_join("s.labels", ",").alias("labels"), "s.score",
                        F.array_join("s.expressions", ",").alias("expressions"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each whole text by a factorization machine learnt from four fifths of the labels.

    A null text counts as empty and has the score of a text without known terms; a null id
    has the fold of the empty text.  Rows that repeat an id train once and are all scored.
    """
    docs, held_out = documents(spark, sf_dir), fold(F.col("doc_id")) == 0
    machine = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"),
                         toxicity.score_column(F.col("text"), machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal probability of each whole text over all its segmentations, and a count baseline.

    A null text counts as empty: one token, the end.  A null id has the fold of the empty
    text.  Rows that repeat an id or text count each time.
    """
    docs, held_out = documents(spark, sf_dir), fold(F.col("doc_id")) == 1
    model = lattice.train(docs, held_out, pieces.read_model(tokenizer_path()))
    return lattice.score(docs, held_out, model)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by three labelers whose reliabilities EM estimates.

    A null text counts as empty: no spans and the digest of the empty text.  Every row is
    treated by itself, so repeated ids and rows each have their own.
    """
    found, _ = pii.personal_data(documents(spark, sf_dir))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> F.Column:
        own = F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
        return F.coalesce(F.size(own), F.lit(0)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.KINDS],
                        hex_sha256(F.coalesce(F.array_join(F.transform(base, name), ","), F.lit(""))).alias("base_sha256"),
                        F.coalesce(F.array_join(F.transform("spans", name), ","), F.lit("")).alias("spans"),
                        F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that each whole text covers, by greedy string tiling.

    Null texts count as empty and match nothing.  Of equal coverages the smallest item id is
    named; repeated rows each have their own.
    """
    found = decontaminate.contaminations(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), out="m")
    return found.select("doc_id", (F.col("m.n_items") > 0).alias("contaminated"), "m.item_id", "m.coverage",
                        "m.n_items", F.size(F.coalesce("m.tiles", F.array())).alias("n_tiles"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw 10 % of the documents of 20 words or more towards the benchmark's word distribution.

    A null text counts as empty: no features, weight 0, never drawn.  Equal scores go to the
    smaller doc_id (null last); rows that repeat one id and score by their stored order.
    """
    docs, target = documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")
    gains = importance.train(docs, target, most=1, buckets=10_000)
    return importance.resample(docs, gains, percent=10, least_words=20, seed=2024)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and one that quotes control strings, and read the result back.

    Null roles and texts count as empty, a null turn comes first, rows that repeat a turn
    count each time, and rows of null conv_id form one conversation.
    """
    own = spark.createDataFrame([(-7, t, r, "\\### Assistant: </turn> ok") for t, r in enumerate(["user", "assistant"])],
                                "conv_id bigint, turn bigint, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    template = chat.Marked()
    return chat.read_back(chat.format_turns(turns, template), template)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language that most exceed chance, of those found 100 times.

    A null text counts as empty, a null lang as ``und``.  Ties go by count, then by the
    phrase's bytes; repeated rows count each time.
    """
    return collocations.collocations(documents(spark, sf_dir), least=100, most=5, covered=100, top=2000)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_simhash, op3_sentencepiece, op4_sharding, op5_quality,
                                   op6_licenses, op7_toxicity, op8_lattice_lm, op9_pii, op10_decontamination,
                                   op11_target_resampling, op12_chat_format, op13_collocations)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MARKED = r"""replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '<turn ', '\<turn ')"""
_MARKED_ROLE = r"""replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>')"""

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
                   FROM documents),
             g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)""",
    # CRC-32 by its byte table, over the distinct words
    "op11_target_resampling": rf"""
        WITH RECURSIVE step(i, v, n) AS (
            SELECT range, range, 0 FROM range(256) UNION ALL
            SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, n + 1 FROM step WHERE n < 8),
        tab AS (SELECT list(v ORDER BY i) AS crc FROM step WHERE n = 8),
        d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
        q AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        vocab AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM d UNION ALL SELECT w FROM q)),
        hashed AS (SELECT w, xor(4294967295, list_reduce(
                       [4294967295] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                       lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 10000 AS b
                   FROM vocab, tab),
        raw AS (SELECT b, count(*) AS s FROM d JOIN hashed USING (w) GROUP BY b),
        tgt AS (SELECT b, count(*) AS t FROM q JOIN hashed USING (w) GROUP BY b),
        gains AS (SELECT k.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM raw) + 10000)::DOUBLE
                       / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM tgt) + 10000)::DOUBLE)))::BIGINT AS gain
                  FROM (SELECT DISTINCT b FROM hashed) k LEFT JOIN raw USING (b) LEFT JOIN tgt USING (b)),
        weighed AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
                    FROM d JOIN hashed USING (w) JOIN gains USING (b) GROUP BY doc_id),
        scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
                       (('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
                   FROM documents LEFT JOIN weighed USING (doc_id)),
        ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
                       PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
        FROM ranked""",
    "op12_chat_format": rf"""
        WITH own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                     UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                     UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length({_MARKED_ROLE}) + length({_MARKED}) + length('<turn >' || '</turn>') + 2)::BIGINT AS formatted_chars
        FROM own GROUP BY conv_id""",
    "op13_collocations": rf"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(
                            unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
        runs AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
                 FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) r(k)) GROUP BY ALL),
        totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
        long AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM runs WHERE k >= 2 AND f >= 100),
        cuts AS (SELECT lang, phrase, f, c, array_to_string(w[1:c], ' ') AS left_part, array_to_string(w[c + 1:k], ' ') AS right_part
                 FROM (SELECT *, unnest(range(1, k)) AS c FROM long)),
        scored AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, (1000 * c.f::HUGEINT * t.n) // (x.f::HUGEINT * y.f) AS score,
                          row_number() OVER (PARTITION BY c.lang, c.phrase
                              ORDER BY (1000 * c.f::HUGEINT * t.n) // (x.f::HUGEINT * y.f), c.c) AS nth
                   FROM cuts c JOIN runs x ON x.lang = c.lang AND x.phrase = c.left_part
                   JOIN runs y ON y.lang = c.lang AND y.phrase = c.right_part JOIN totals t ON t.lang = c.lang),
        kept AS (SELECT * FROM scored s WHERE nth = 1 AND NOT EXISTS (
                     SELECT 1 FROM long q WHERE q.lang = s.lang AND 100 * q.f >= 100 * s.a AND q.phrase <> s.phrase
                     AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' ')))
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000""",
}
