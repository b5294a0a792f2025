"""Importance resampling, chat formatting and phrase collocations against brute-force versions, and edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from regionlens.llm import chat, collocations, importance, queries
from regionlens.llm import text as tx
from regionlens.llm.tables import documents, read_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the templates below go to the workers
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = ["", None, " ", "\n\t", "a", "A", "one two", "x" * 200_000, "Long words " * 20_000, "é 日本 𝒳 \x00 ☃", "one two"]


def table(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in zip(ids, texts, langs)], SCHEMA).repartition(3)


# 11 importance resampling

def brute_features(text, most, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets
                   for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, percent, least, seed, most, buckets):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text), the order of ties by place."""
    raw, want = Counter(), Counter()
    for _, t in rows:
        raw.update(brute_features(t, most, buckets)[1])
    for t in target:
        want.update(brute_features(t, most, buckets)[1])
    s, t = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out, able = [], []
    for n, (i, text) in enumerate(rows):
        words, found = brute_features(text, most, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if len(words) >= least:
            able.append((-score, math.inf if i is None else i, n))
    for rank, (_, _, n) in enumerate(sorted(able)[:percent * len(able) // 100], 1):
        out[n][4] = rank
    return [tuple(r) for r in out]


def sort_key(row):
    return tuple((x is None, x or 0) for x in row)


def test_resampling_brute(spark):
    small = documents(spark, SMALL).toPandas()
    bench = read_table(spark, SMALL, "benchmark").toPandas().text.tolist()
    want = brute_resample(list(zip(small.doc_id.tolist(), small.text.tolist())), bench, 10, 20, 2024, 1, 10_000)
    got = [tuple(r) for r in queries.op11_target_resampling(spark, SMALL).collect()]
    assert sorted(got, key=sort_key) == sorted(want, key=sort_key)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_edges(spark, most):
    texts = [*EDGES, *["one two three"] * 9]
    ids = [*range(len(EDGES)), None, None, 3, 3, 3, 3, -5, 1 << 62, 90]
    docs = table(spark, texts, ids).withColumn("score", F.lit(1)).withColumn("nth", F.lit(2)).withColumn("a.b", F.lit(3))
    target = spark.createDataFrame([("one two",), (None,), ("",)], "text string")
    gains = importance.train(docs, target, most=most, buckets=97)
    for percent in (0, 30, 100):
        got = [tuple(r) for r in importance.resample(docs, gains, percent, least_words=2, seed=7).collect()]
        want = brute_resample(list(zip(ids, texts)), ["one two", None, ""], percent, 2, 7, most, 97)
        assert sorted(got, key=sort_key) == sorted(want, key=sort_key)
    empty = table(spark, [])
    assert importance.resample(empty, importance.train(empty, target.where("false")), 50).count() == 0


def test_bucket_of_long_words():
    texts = ["a" * n + " " + "é" * n for n in (1, 2, 31, 32, 33, 64, 5000)] + ["x", "", "ABC def 12"]
    rows, found, words = importance.features(*tx.buffers(pa.array(texts)), 3, 1 << 31)
    for i, t in enumerate(texts):
        w, want = brute_features(t, 3, 1 << 31)
        assert sorted(found[rows == i].tolist()) == sorted(want) and words[i] == len(w)


@pytest.mark.parametrize("seed", range(4))
def test_kth_key(spark, seed):
    rng = np.random.default_rng(seed)
    keys = sorted({tuple(int(x) for x in rng.integers(-3, 4, 2)) + (i,) for i in range(rng.integers(1, 400))})
    docs = spark.createDataFrame([keys[i] for i in rng.permutation(len(keys))], "k1 bigint, k2 bigint, k3 bigint").repartition(5)
    for k in (1, len(keys) // 3 + 1, len(keys)):
        assert importance.kth_key(docs, k) == keys[k - 1]
    assert importance.kth_key(docs, 0) is None and importance.kth_key(docs, len(keys) + 1) is None


def test_each_round_rules_out_a_quarter(spark, monkeypatch):
    docs = spark.range(4000).select(F.xxhash64("id").alias("k1"), F.lit(0).cast("bigint").alias("k2"),
                                    F.col("id").alias("k3")).repartitionByRange(7, "k1")
    sizes, plain = [], importance._reports
    monkeypatch.setattr(importance, "_reports", lambda t, p: sizes.append(t.count()) or plain(t, p))
    importance.kth_key(docs, 400)
    assert all(b <= 0.75 * a + 7 for a, b in zip(sizes[1:], sizes[2:]))


# 12 chat formatting

BITS = ["\\", "<turn ", "</turn>", "### Assistant:", "a", "\n", ">", "<", " ", "é", "𝒳"]


def random_turns(rng, n, most=9):
    return [(c, t, rng.choice(["user", "assistant", "system", "<x>\\"]), "".join(rng.choices(BITS, k=rng.randint(0, 8))))
            for c in range(n) for t in range(rng.randint(1, most))]


def digest(turns, template):
    """What `read_back` gives for one conversation of (role, text)."""
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), len(template(turns)))


TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_marked_round_trip_and_windows(spark):
    rng = random.Random(3)
    rows = random_turns(rng, 40) + [(900, t, "user" if t % 2 else "assistant", f"turn {t} </turn>" * (t % 5)) for t in range(500)]
    rows += [(901, 0, None, None), (901, 1, "assistant", None), (None, 0, "user", "n"), (None, None, "assistant", "first"),
             (902, 3, "user", "b"), (902, 3, "assistant", "b"), (902, 3, "assistant", "a"), (902, 3, "user", "b"),
             (903, 0, "assistant", "é𝒳" * 100_000), (903, 1, "user", "x" * 1_500_000), (903, 2, "assistant", "end")]
    turns = spark.createDataFrame(rows, TURNS).repartition(4).withColumn("piece", F.lit(1)).withColumn("a.b", F.lit(1))
    template = chat.Marked()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    own = defaultdict(list)
    for r in sorted(rows, key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    for window, chars in ((64, 1 << 20), (3, 50)):
        spans = chat.format_turns(turns, template, window=window, chars=chars)
        got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(spans, template).collect()}
        assert got == {c: digest(t, template) for c, t in own.items()}
        assert chat.rewriting(spans).count() == 0
    text = defaultdict(str)
    for r in sorted(spans.collect(), key=lambda r: r.end):
        text[r.conv_id] = text[r.conv_id][:r.keep] + r.piece
        assert r.loss == (r.role == "assistant") and text[r.conv_id][r.start:r.end] == r.piece
    assert dict(text) == {c: template(t) for c, t in own.items()}
    empty = chat.format_turns(turns.where("false"), template)
    assert empty.count() == 0 and chat.read_back(empty, template).count() == 0


def preamble(turns):
    head = "" if turns and turns[0][0] == "system" else "[be helpful]"
    return "<s>" + head + "".join(f"{r}: {t.strip()}\n" for r, t in turns)


def forgetful(turns):
    """Takes the words of all but the last assistant turn back."""
    last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return "".join(f"[{r}]{'...' if r == 'assistant' and i < last else t};" for i, (r, t) in enumerate(turns))


def counting(turns):
    return "".join(f"{len(t)}:{r}:{t}," for r, t in turns)


def numbered(turns):
    return "".join(f"({i} {r}) {t}\n" for i, (r, t) in enumerate(turns))


# what has left a window of 3 cannot be seen to be rewritten, so the forgetful one has the default
@pytest.mark.parametrize("template,window", [(preamble, 64), (preamble, 3), (forgetful, 64), (counting, 64), (counting, 3),
                                             (numbered, 64), (numbered, 3)])
def test_black_boxes(spark, template, window):
    rng = random.Random(5)
    rows = random_turns(rng, 20) + [(77, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(40)]
    rows += [(78, 0, "assistant", "one"), (78, 1, "user", "two"), (78, 2, "assistant", "three")]
    spans = chat.format_turns(spark.createDataFrame(rows, TURNS), template, window=window).collect()
    own, text = defaultdict(list), defaultdict(str)
    for r in rows:
        own[r[0]].append((r[2], r[3]))
    at = defaultdict(int)
    for r in sorted(spans, key=lambda r: (r.conv_id, r.turn)):
        said = own[r.conv_id][at[r.conv_id]][1]
        at[r.conv_id] += 1
        text[r.conv_id] = text[r.conv_id][:r.keep] + r.piece
        assert text[r.conv_id] == template(own[r.conv_id][:at[r.conv_id]])
        if r.body_start is not None:
            assert text[r.conv_id][r.body_start:r.body_end] == (said.strip() if template is preamble else said)
    taken = {r.conv_id for r in spans if r.dropped}
    assert (78 in taken) == (template is forgetful) and (template is forgetful or not taken)
    if template is counting:
        assert not any(r.loss for r in spans if r.role == "assistant" and len(own[r.conv_id][r.turn][1]) != 1)
    if template in (preamble, numbered):
        assert all(r.loss == (r.role == "assistant") for r in spans)


# 13 collocations

def brute_phrases(rows, least, most, top):
    """rows: (lang, text)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i:i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        long = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in long.items():
            if any(b >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in long.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                        for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s)
                for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_collocations_brute(spark, seed, monkeypatch):
    monkeypatch.setattr(collocations, "SPAN", 3)
    monkeypatch.setattr(collocations, "HELD", 200)
    rng = random.Random(seed)
    words = ["The", "the", "of", "mice", "é", "日本", "x" * 40, "a_b", "\x01", "𝒳y"]
    rows = []
    for _ in range(90):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r", ";"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "fr", None, "und"]), text + rng.choice(["", " of mice and men, of mice and men"])))
    rows += [("en", "the mice of the mice of the mice of the")] * 20 + [("en", t) for t in EDGES]
    docs = table(spark, [t for _, t in rows], [None if i % 7 == 0 else i % 50 for i in range(len(rows))], [x for x, _ in rows])
    docs = docs.withColumn("phrase", F.lit(1)).withColumn("k", F.lit(1)).withColumn("a.b", F.lit(1))
    for least, most, top in ((4, 5, 2000), (2, 3, 5), (9, 4, 40)):
        got = collocations.collocations(docs, least, most, 100, top, shards=5)
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, most, top)


def test_collocations_edges(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, EDGES), least=10**6).count() == 0
    got = collocations.collocations(table(spark, EDGES), least=1000).collect()
    assert [(r.lang, r.phrase) for r in got] == [(x[0], x[2]) for x in brute_phrases([(None, t) for t in EDGES], 1000, 5, 2000)]


def test_collocation_scores_pass_64_bits(spark):
    big = 40_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", 3 * big), ("en", 1, "b", 7 * big), ("en", 2, "a b", big)],
                                   "lang string, k int, phrase string, f bigint")
    totals = spark.createDataFrame([("en", 10**13 + 7)], "lang string, total bigint")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "frequent_phrases", lambda *a: (counts, totals))
        row = collocations.collocations(table(spark, ["x"])).first()
    assert row.score == 1000 * big * (10**13 + 7) // (21 * big * big) and row.a == big
