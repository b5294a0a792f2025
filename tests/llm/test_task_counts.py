"""A task gives out each phrase once, and the table's false bits let few other runs through."""

from collections import Counter

import numpy as np
import pyarrow as pa

from regionlens.llm import collocations


def counted(texts, most, table):
    """The rows a task gives out for batches of 20 texts."""
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * len(x)), pa.array(x)], names=["lang", "text"])
               for x in (texts[a:a + 20] for a in range(0, len(texts), 20))]
    return [(r["k"], r["phrase"], r["n"]) for b in collocations._task_counts(iter(batches), most, table) for r in b.to_pylist()]


def brute(texts, most):
    out = Counter()
    for text in texts:
        w = text.split()
        out.update((k, " ".join(w[i:i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    return {(k, p, n) for (k, p), n in out.items()}


def test_each_phrase_once(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "d"], 12)) for _ in range(400)]
    every = np.full(1 << (collocations.BITS - 3), 255, np.uint8)
    want = brute(texts, 3)
    monkeypatch.setattr(collocations, "HELD", 600)   # reached at about every fifth batch; all that differ fit in its half
    got = counted(texts, 3, every)
    assert len(got) == len(want) and set(got) == want
    monkeypatch.setattr(collocations, "HELD", 40)    # too little for the different ones
    sums = Counter()
    for k, phrase, n in counted(texts, 3, every):
        sums[k, phrase] += n
    assert {(k, p, n) for (k, p), n in sums.items()} == want


def test_false_bits_need_their_parts():
    texts = [f"big cat sat x{i} y{i} z{i}" for i in range(3000)]
    table = np.zeros(1 << (collocations.BITS - 3), np.uint8)
    rng = np.random.default_rng(5)
    table |= (rng.random(len(table)) < 0.3).astype(np.uint8) << 3   # false bits: some four in a hundred
    whole = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["big cat sat"])], names=["lang", "text"])
    for _langs, _codes, seeds, _shards, words in collocations._parts(iter([whole]), False):
        for k in (1, 2, 3):
            place = words.runs(k, seeds)[1] >> np.uint64(64 - collocations.BITS)
            np.bitwise_or.at(table, (place >> np.uint64(3)).astype(np.int64), np.left_shift(1, (place & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    rows = counted(texts, 3, table)
    assert {(k, p) for k, p, n in rows if n == 3000} >= {(1, "big"), (2, "big cat"), (3, "big cat sat")}
    assert len([p for k, p, _ in rows if k == 1]) > 100 and len([p for k, p, _ in rows if k == 3]) <= 20
