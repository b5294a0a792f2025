"""Every operator against a brute-force version, and the edge rows: nulls, empty and very
long texts, ties, repeats, empty tables and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from regionlens.llm import (components, decontaminate, exact_dedup, lattice, licenses, pieces, pii, quality, queries,
                            sharding, simhash, toxicity)
from regionlens.llm import text as tx
from regionlens.llm.tables import documents, fold, read_table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGES = ["", None, " ", "\n\t", "a", "A", "one two", "one  two", "x" * 200_000, "long words " * 20_000,
         "é 日本 𝒳 ▁ \x00 ☃", "one two"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(queries.tokenizer_path())


@pytest.fixture(scope="module")
def small(spark):
    return documents(spark, SMALL).toPandas()


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", 1) for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def normal(t):
    return re.sub(r"[ \t-\r]+", " ", t or "")


# 1 exact dedup

def test_exact_dedup_brute(spark, small):
    got = {r.doc_id: r for r in queries.op1_exact_dedup(spark, SMALL).collect()}
    groups = defaultdict(list)
    for i, t in zip(small.doc_id, small.text):
        groups[normal(t)].append(i)
    assert len(got) == len(small)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), i == min(ids))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_index_persists(spark):
    index = queries.new_index(spark)
    first = index.assign(table(spark, ["a b", "c"], [5, 6]))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in first.collect()) == [(5, 5, True), (6, 6, True)]
    again = index.assign(table(spark, ["a  b", "d", "d", "c"], [1, 9, 8, 6]))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again.collect()) == [
        (1, 5, False), (6, 6, True), (8, 8, True), (9, 8, False)]
    assert index.rows().count() == 3
    assert index.assign(table(spark, [], [])).count() == 0
    plan = spark.sql(f"DESCRIBE EXTENDED {index.table}").collect()
    assert any(r.col_name == "Bucket Columns" and "digest" in r.data_type for r in plan)


def test_exact_dedup_unique_rows_edges(spark):
    docs = table(spark, [*EDGES, "one two", "one two"], [*range(len(EDGES)), None, 6])
    docs = docs.withColumn("digest", F.lit(1)).withColumn("_copies", F.lit(2)).withColumn("a.b", F.lit(3))
    kept = exact_dedup.unique_rows(docs, queries.new_index(spark))
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({normal(t) for t in EDGES})
    assert Counter(r.doc_id for r in rows if r.text and r.text.startswith("one")) == {6: 1}
    nulls = exact_dedup.unique_rows(table(spark, ["q", "q"], [None, None]), queries.new_index(spark))
    assert nulls.count() == 1


# 2 SimHash

def brute_print(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(prints.items(), 2):
        if (a ^ b).bit_count() <= 3:
            parent[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in prints}


def test_simhash_brute(spark, small):
    got = {r.doc_id: r for r in queries.op2_simhash(spark, SMALL).collect()}
    prints = {i: brute_print(t) for i, t in zip(small.doc_id, small.text)}
    want = brute_components(prints)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {
        i: (f"{p:016x}", want[i]) for i, p in prints.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_links_and_components(spark, seed):
    rng = random.Random(seed)
    own = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63}
    for p in list(own):  # chains and balls around some
        for _ in range(rng.randint(0, 6)):
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
            own.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in own]
    fps = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    pairs = {(r.a, r.b) for r in simhash.linked_pairs(fps).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2)
            if ((a ^ b) & tx.MASK).bit_count() <= 3}
    assert pairs == want
    roots = {r.node: r.root for r in components.connected(
        spark.createDataFrame(list(pairs), "a bigint, b bigint")).collect()}
    full = brute_components({p: p & tx.MASK for p in sorted(signed)})
    linked = {p for pair in want for p in pair}
    assert roots == {p: full[p] for p in linked}


def test_components_long_path(spark):
    path = spark.range(300).selectExpr("(id * 7919) % 301 AS x", "((id + 1) * 7919) % 301 AS y").selectExpr(
        "least(x, y) AS a", "greatest(x, y) AS b")
    assert {r.root for r in components.connected(path).collect()} == {0}


def test_simhash_edges(spark):
    docs = table(spark, EDGES, [*range(len(EDGES) - 1), None]).withColumn("fp", F.lit("x"))
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp & tx.MASK for r in got} == {
        (i if i < len(EDGES) - 1 else None): brute_print(t) for i, t in enumerate(EDGES)}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and 4 <= kept.count() < len(EDGES)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_one_of_each_decides_by_row(spark):
    rng = random.Random(4)
    plain = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(5)]
    rows = [(7, plain[0]), (7, plain[1]), (7, plain[2]), (3, plain[2]),     # one id on several texts, one a copy
            (8, plain[3]), (8, plain[3].upper()), (8, plain[3].upper()),    # near copies under one id
            (None, plain[4]), (None, plain[4].upper())]                     # and without an id
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("_copies", F.lit("x"))
    first = [min(t, t.upper(), key=lambda x: hashlib.sha256(x.encode()).digest()) for t in plain]
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(7, plain[0]), (7, plain[1]), (3, plain[2]), (8, first[3]), (None, first[4])], key=str)


# 3 SentencePiece

def test_sentencepiece_matches_library(spark, small, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for r in queries.op3_sentencepiece(spark, SMALL).collect():
        ids = sp.encode(small.text[small.doc_id == r.doc_id].iloc[0] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_sentencepiece_columns_agree(spark, model):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "  two  words ", "日本 \x00é", "x" * 5000])],
                                  "doc_id long, text string")
    both = texts.select("*", pieces.round_trip_column(F.col("text"), model).alias("t"),
                        pieces.encode_column(F.col("text"), model).alias("ids"))
    for r in both.withColumn("decoded", pieces.decode_column(F.col("ids"), model)).collect():
        assert r.t.ids == r.ids and r.t.decoded == r.decoded == (r.text or "")
    assert texts.limit(0).select(pieces.round_trip_column(F.col("text"), model).alias("t")).count() == 0


def test_sentencepiece_random_texts(model):
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PrefixEncoder(model, memory=500)
    rng = random.Random(3)
    bits = ["a", "b", " ", "  ", " " * 9, " " * 40, "\n", "er", "th", "▁", "é", "日", "𝒳", "\x00", "====", "<s>", "①", "�"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) if rng.random() < 0.5 else rng.choice(own.pieces[259:])
                       for _ in range(rng.randint(0, 12)))
        ids = own.encode(text)
        assert ids == sp.encode(text)
        assert own.decode(ids) == sp.decode(ids)
        odd = [rng.randrange(32000) for _ in range(3)] + [rng.randrange(259) for _ in range(4)]
        rng.shuffle(odd)
        assert own.decode(odd) == sp.decode(odd)
    for text in [t or "" for t in EDGES]:
        assert own.encode(text) == sp.encode(text)


# 4 sharding

def test_sharding_balanced(spark, small):
    rows = sorted(queries.op4_sharding(spark, SMALL).collect(), key=lambda r: r.doc_id)
    size = {i: len((t or "").encode()) + 16 for i, t in zip(small.doc_id, small.text)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (size[i], zlib.crc32((t or "").encode())) for i, t in zip(small.doc_id, small.text)}
    total, before, slots = sum(size.values()), 0, Counter()
    for r in rows:
        assert r.shard == (2 * before + r.size) * 40 // (2 * total)
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
        before += r.size


def test_sharding_edges(spark):
    docs = table(spark, EDGES + ["r"] * 50, [*range(len(EDGES)), *[7] * 49, None]).withColumn("size", F.lit(0))
    got = sharding.balanced_shards(docs, 3).collect()
    assert len(got) == len(EDGES) + 50
    for s, rows in itertools.groupby(sorted(got, key=lambda r: r.shard), lambda r: r.shard):
        assert sorted(r.slot for r in rows) == list(range(sum(r.shard == s for r in got)))
    assert sharding.balanced_shards(table(spark, []), 3).count() == 0


# 5 quality

def test_quality_held_out(spark):
    got = queries.op5_quality(spark, "/root/testdata/sf0.01").join(
        read_table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where(fold(F.col("doc_id")) == 0).toPandas()
    good, bad = got.weight[got.quality == 1].to_numpy(), got.weight[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.85


def test_quality_counts_and_cut(spark, small):
    docs = documents(spark, SMALL)
    counts = quality.gram_counts(docs)
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[!-/:-@\[-`{-\x7F]+", t.translate(licenses._UPPER))
             for t in small.text]
    assert counts.sum() == sum(len(w) + max(0, len(w) - 1) for w in words)
    ratio = quality.Ratio(np.zeros(quality.BUCKETS))
    for fraction in (0.0, 0.25, 1.0):
        rows = quality.resample(docs, ratio, fraction).collect()
        chosen = [r.key for r in rows if r.selected]
        assert len(chosen) >= round(fraction * len(small)) and len(set(chosen)) <= round(fraction * len(small))
        assert not chosen or min(chosen) >= max([r.key for r in rows if not r.selected], default=min(chosen))
    edges = quality.resample(table(spark, EDGES), ratio, 0.5).collect()
    assert len(edges) == len(EDGES) and not any(r.selected for r in edges if not (EDGES[r.doc_id] or "").strip())
    assert quality.resample(table(spark, []), ratio, 0.5).count() == 0


# 6 licences

def test_licenses_base_brute(spark, small):
    for r in queries.op6_licenses(spark, SMALL).collect():
        text = small.text[small.doc_id == r.doc_id].iloc[0]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(licenses._UPPER))
        hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words))
                if words[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_licenses_random_places():
    scanner, rng = licenses.Scanner(), random.Random(1)
    bits = ["under", "the", "mit", "license", "apache", "version", "2", "2.0", "cc", "by", "nc", "-", ", ", "é", "CC-BY-NC"]
    for _ in range(1500):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(licenses._UPPER))
        want = sorted((i, len(p.split()), label) for p, label in licenses.BASE.items() for i in range(len(words))
                      if words[i:i + len(p.split())] == p.split())
        got = scanner.scan(text)
        assert [(p["word"], p["words"], p["label"]) for p in got["places"]] == want
        assert got["n_words"] == len(words)


def test_license_expressions():
    def value(e):
        return licenses.evaluate(licenses.postfix(e))

    assert value("MIT") == ({"mit"}, 1.0)
    assert value("GPL-3.0 OR MIT AND CC-BY-NC-4.0")[1] == pytest.approx(0.4)
    assert value("(GPL-3.0 OR MIT) AND CC-BY-NC-4.0")[1] == pytest.approx(0.1)
    assert value("GPL-2.0 WITH Classpath-exception-2.0") == ({"gpl-2.0"}, licenses.EXCEPTION)
    assert value("MIT AND (") == ({"mit"}, 1.0) and value("MIT OR") == ({"mit"}, 1.0)
    assert value("((MIT)") == ({"mit"}, 1.0) and value(")") == (set(), 1.0)
    found = licenses.Scanner().scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND Foo\ncode under the MIT license")
    assert found["labels"] == ["apache-2.0", "foo", "mit"] and found["base_labels"] == ["mit"]
    assert found["score"] == licenses.UNKNOWN and found["expressions"] == ["mit apache-2.0 or foo and"]


# 7 toxicity

def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, path).join(read_table(spark, path, "labels"), "doc_id").where("held_out").toPandas()
    bad, good = got.score[got.toxic == 1].to_numpy(), got.score[got.toxic == 0].to_numpy()
    auc = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    assert auc > 0.95 and (good >= 0.5).mean() < 0.01


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(float)
    rows, places = np.nonzero(x)
    machine = toxicity.fit(rows, places, y, np.arange(6, dtype=np.uint64), epochs=40)
    assert (((machine.logits(rows, places, len(y)) > 0) == (y > 0)).mean()) > 0.99


def test_toxicity_logits_are_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(np.arange(9, dtype=np.uint64), 0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    x = rng.random((40, 9)) < 0.4
    want = [0.3 + sum(machine.weights[i] for i in np.flatnonzero(r))
            + sum(machine.factors[i] @ machine.factors[j] for i, j in itertools.combinations(np.flatnonzero(r), 2)) for r in x]
    assert np.allclose(machine.logits(*np.nonzero(x), len(x)), want)


def test_toxicity_scores_by_brute_force():
    rng = np.random.default_rng(2)
    texts = ["you vile worm", "kind soul", "", "VILE kind Worm é", "worm " * 300]
    plain = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) for t in texts]
    words = ["vile", "worm", "kind", "é"]
    hashes = np.array([tx.word_hashes(*tx.buffers(pa.array([w])))[1][0] for w in words])
    order = np.argsort(hashes)
    machine = toxicity.Machine(hashes[order], -0.2, rng.normal(size=4), rng.normal(size=(4, 2)))
    w, v = (dict(zip([words[i] for i in order], x)) for x in (machine.weights, machine.factors))
    for t, got in zip(plain, machine.scores(*tx.buffers(pa.array(texts)), tx.HashSet(machine.terms))):
        own = sorted(t & set(words))
        z = -0.2 + sum(w[a] for a in own) + sum(v[a] @ v[b] for a, b in itertools.combinations(own, 2))
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_catches_pairs_of_benign_words(spark):
    """An insult beside a group mention is toxic, each alone is not; another word is toxic by itself."""
    rng = random.Random(0)
    vocabulary = [f"w{i}x" for i in range(800)]
    kinds = {0: ["zorgle"], 1: ["plimfolk"], 2: ["zorgle", "plimfolk"], 3: ["vexmuck"], 4: []}

    def make(n, shift):
        out = []
        for i in range(n):
            kind = {0: 2, 1: 3, 2: 3}.get(i % 20, 0 if i % 20 < 8 else 1 if i % 20 < 13 else 4)
            words = rng.choices(vocabulary, k=40) + kinds[kind]
            rng.shuffle(words)
            out.append((i + shift, " ".join(words), kind))
        return out

    train, test = make(4000, 0), make(1000, 10_000)
    labels = spark.createDataFrame([(i, int(k in (2, 3))) for i, _, k in train], "doc_id bigint, toxic int")
    machine = toxicity.train(table(spark, [t for _, t, _ in train]), labels, F.lit(True))
    scores = machine.scores(*tx.buffers(pa.array([t for _, t, _ in test])), tx.HashSet(machine.terms))
    kind = np.array([k for _, _, k in test])
    for k, toxic in ((0, False), (1, False), (2, True), (3, True), (4, False)):
        assert ((scores[kind == k] >= 0.5) == toxic).mean() >= 0.95, k


def test_toxicity_takes_one_row_of_each_id(spark, monkeypatch):
    rows = [(i % 40, f"you {'vile worm' if i % 2 else 'kind soul'} {i}") for i in range(80)]
    rows += [(1, f"hot id row {i}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    sizes, plain = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, places, y, terms: sizes.append((len(y), y.sum())) or plain(rows, places, y, terms))
    toxicity.train(table(spark, [t for _, t in rows], [i for i, _ in rows]), labels, F.lit(True), bound=30)
    assert sizes[0][0] == 30 and sizes[0][1] <= 20


def test_toxicity_of_an_empty_table(spark):
    empty, labels = table(spark, []), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    machine = toxicity.train(empty, labels, F.lit(True))
    assert empty.select(toxicity.score_column(F.col("text"), machine)).count() == 0


def test_toxicity_edges(spark):
    docs = table(spark, EDGES)
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    machine = toxicity.train(docs, labels, F.lit(True))
    scores = docs.select(toxicity.score_column(F.col("text"), machine).alias("s")).collect()
    assert len(scores) == len(EDGES) and all(0 <= r.s < 0.5 for r in scores)
    none = toxicity.train(docs, labels.where("false"), F.lit(True))
    assert docs.select(toxicity.score_column(F.col("text"), none).alias("s")).first().s == pytest.approx(0.5)


# 8 lattice scores

def brute_marginal(pieces_, p, word):
    own = {s: p[i] for i, s in enumerate(pieces_.surfaces)}
    word = b" " + word
    alpha = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        alpha[j] = sum(alpha[i] * own.get(word[i:j], 0.0) for i in range(j))
    return alpha[-1]


def test_lattice_forward_and_expected(model):
    own = lattice.Pieces(model)
    p = own.first_guess()
    assert p.sum() == pytest.approx(1) and (p > 0).all()
    words = [b"the", b"a", b"thinor", "éè".encode(), b"zz9", b"x" * 40, "日本𝒳".encode(), b"the"]
    net = lattice.Lattice(own, words)
    got = net.forward(np.log(p))[net.last]
    assert np.exp(got) == pytest.approx([brute_marginal(own, p, w) for w in words])
    counts = np.arange(1.0, len(words) + 1)
    expected = net.expected(np.log(p), counts)
    assert sum(n * len(s) for n, s in zip(expected, own.surfaces)) == pytest.approx(
        sum((len(w) + 1) * c for w, c in zip(words, counts)))


def test_lattice_model_brute(spark, small, model):
    docs, held = documents(spark, SMALL), fold(F.col("doc_id")) == 1
    trained = lattice.train(docs, held, model)
    rows = {f: lattice.score(docs, held, trained, frequent=f).toPandas().set_index("doc_id") for f in (50, 100_000)}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in zip(small.doc_id, small.text)}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v, own = sum(c.values()), len(c), lattice.Pieces(model)
    p = np.exp(trained.log_p)
    assert p.sum() + np.exp(trained.end_lp) == pytest.approx(1)
    for i, ws in itertools.islice(tokens.items(), 40):
        for r in (x.loc[i] for x in rows.values()):
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(w in c for w in ws), n)
            assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    i = min(tokens, key=lambda i: len(tokens[i]))
    want = sum(np.log10(brute_marginal(own, p, w)) for w in tokens[i][:-1]) + trained.end_lp / np.log(10)
    assert rows[50].score[i] == pytest.approx(want) and rows[100_000].score[i] == pytest.approx(want)
    # more likely than under the vocabulary's own scores
    first = lattice.score(docs, held, lattice.train(docs, held, model, rounds=0)).toPandas().set_index("doc_id")
    at = [i for i in tokens if out[i]]
    assert rows[50].score[at].sum() > first.score[at].sum() + sum(1.0 for _ in at)


def test_lattice_edges(spark, model):
    docs = table(spark, EDGES, [*range(len(EDGES) - 2), None, 0])
    held = fold(F.col("doc_id")) == 1
    got = lattice.score(docs, held, lattice.train(docs, held, model, rounds=1), frequent=2).collect()
    assert len(got) == len(EDGES) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    empty = table(spark, [])
    assert lattice.score(empty, F.lit(False), lattice.train(empty, F.lit(False), model)).count() == 0


# 9 personal data

def brute_spans(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.STRICT_PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits)))
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return sorted(out)


def test_pii_base_brute(spark, small):
    rng = random.Random(5)
    bits = ["a@b.c", "_d@e.f", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 123-4567", "@", ".", "..",
            "a", "é", "𝒳", "9", "0", "255", "256.1.1.1", "-", " ", "+", "(", "\n", "0001", "x@y", "call ",
            "5555-5555-5555-4444", "name (at) site (dot) com", "555-123-4567", "378282246310005", "2001:db8:0:0:0:0:0:1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [t for t in small.text if len(t) < 5000] + ["", None]
    found, _ = pii.personal_data(table(spark, texts))
    got = {r.doc_id: r.spans or [] for r in found.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.order, s.start, s.end) for s in got[i] if s.base] == brute_spans(t or ""), t
        own = [(s.order, s.start, s.end) for s in got[i]]
        assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(own, own[1:]))
    assert any(not s.base for v in got.values() for s in v)


def test_pii_long_and_odd(spark):
    texts = EDGES + ["1" * 100_000, "+" * 50_000, "1 " * 50_000, "a@" * 20_000, "1." * 30_000, "a@b.c " * 3_000]
    got = {r.doc_id: r.spans or [] for r in pii.personal_data(table(spark, texts))[0].collect()}
    assert len(got) == len(texts) and len(got[len(texts) - 1]) == 3_000
    assert pii.personal_data(table(spark, []))[0].count() == 0


def test_pii_labelers_are_weighed():
    votes = dict(v_context=0, strict=True, apart=True, grouped=False)
    rows = [dict(kind="card", v_pattern=1, v_gazetteer=1, n=90, **votes),
            dict(kind="card", v_pattern=-1, v_gazetteer=-1, n=90, **votes),
            dict(kind="card", v_pattern=-1, v_gazetteer=1, n=10, **votes)]
    known = pii.reliabilities(rows)["card"]
    assert pii.posterior(rows[0], **known) > 0.9 > 0.1 > pii.posterior(rows[1], **known)


# 10 decontamination

def brute_tiles(a, b, least):
    a, b, out = list(a), list(b), []
    fa, fb = [True] * len(a), [True] * len(b)
    while True:
        best = []
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                n += 1
            best.append((n, i, j))
        n = max([x[0] for x in best], default=0)
        if n < least:
            return out
        for m, i, j in best:
            if m == n and all(fa[i:i + n]) and all(fb[j:j + n]):
                fa[i:i + n] = fb[j:j + n] = [False] * n
                out.append((i, j, n))


def test_tiles_brute():
    rng = np.random.default_rng(2)
    for k in range(150):
        a, b = (rng.integers(0, 3 + k % 5, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        least = min(3, len(a))
        assert decontaminate.tiles(a, b, 3) == brute_tiles(a, b, least)


def test_decontamination_finds_reordered(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20)] + ["", None, "tiny item"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    a = items[3].split()
    noise = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
    texts = [f"{noise[0]} {items[2]} {noise[1]}", " . ".join([" ".join(a[20:]), noise[2], " ".join(a[:20])]).upper(),
             " ".join(a[:10]) + " " + noise[3], "a Tiny, item!", *noise[4:], *EDGES]
    docs = table(spark, texts).withColumn("match", F.lit("own")).withColumn("_match", F.lit(0))
    for size in (1 << 20, 600):  # one block, several with stored passes between
        got = {r.doc_id: r.m for r in decontaminate.contaminations(docs, bench, out="m", block_bytes=size).collect()}
        assert [i for i, m in got.items() if m.n_items] and sorted(i for i, m in got.items() if m.n_items) == [0, 1, 3]
        assert (got[0].item_id, got[1].item_id, got[3].item_id) == (2, 3, 22)
        assert got[1].coverage == 1.0 and len(got[1].tiles) == 2 and 0.3 < got[2].coverage < 0.4
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 3
    assert decontaminate.clean(docs, bench.where("false")).count() == len(texts)
    assert decontaminate.clean(table(spark, []), bench).count() == 0


# text helpers

def test_word_hashes_do_not_depend_on_cuts(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é,. \n日9") for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["y" * 900]
    whole = tx.word_hashes(*tx.buffers(pa.array(texts)))
    grams = tx.byte_grams(*tx.buffers(pa.array(texts)))
    monkeypatch.setattr(tx, "CHUNK", 64)
    monkeypatch.setattr(tx, "_POWERS", {})
    cut = tx.word_hashes(*tx.buffers(pa.array(texts)))
    cut_grams = tx.byte_grams(*tx.buffers(pa.array(texts)))
    assert all(np.array_equal(a, b) for a, b in zip(whole + grams, cut + cut_grams))
    want = [(i, w) for i, t in enumerate(texts)
            for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(licenses._UPPER))]
    assert [i for i, _ in want] == whole[0].tolist()
    assert len({h for h in whole[1].tolist()}) == len({w for _, w in want})


# the pipeline

def test_pipeline_brute(spark, small, model):
    docs = documents(spark, SMALL)
    left = {0: small.set_index("doc_id").text.to_dict()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.toPandas(), SCHEMA)
        left[k + 1] = {r.doc_id: r for r in out.collect()}
    groups = defaultdict(list)
    for i, r in left[1].items():
        groups[normal(r.text)].append(i)
    assert set(left[2]) == {min(g) for g in groups.values()}
    comps = brute_components({i: brute_print(r.text) for i, r in left[2].items()})
    assert set(left[3]) == set(comps.values())
    items = [re.findall(r"\w+", t.lower()) for t in read_table(spark, SMALL, "benchmark").toPandas().text]
    whole = {i for i, r in left[3].items() if any(" ".join(w) in " ".join(re.findall(r"\w+", r.text.lower())) for w in items)}
    assert set(left[4]) == set(left[3]) - whole
    encoder = pieces.PrefixEncoder(model)
    assert {i: list(r.ids) for i, r in left[5].items()} == {i: encoder.encode(r.text) for i, r in left[4].items()}
    assert all(r.decoded == left[4][i].text.replace("▁", " ") for i, r in left[5].items())


def test_pipeline_edges(spark, tmp_path):
    docs = table(spark, EDGES, [*range(len(EDGES) - 1), None])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        read_table(spark, SMALL, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count() < len(EDGES)


def test_licence_expression_ends_with_its_line():
    assert licenses.postfix("MIT OR\nISC") == ["mit"]
    found = licenses.Scanner().scan("license-identifier: mit and\nisc " + "license-identifier: zlib or bsd text " * 3000)
    assert found["labels"] == ["bsd", "mit", "zlib"] and len(found["expressions"]) == 3001
