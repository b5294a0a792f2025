"""Benchmark decontamination by greedy string tiling.

A document and a benchmark passage are compared only if they share a run of five words.
Then the longest common run of words that nothing has covered yet is marked, again and
again, until no run of five is left: long tiles first, each word of either side in one
tile at most.  Runs are found by running (Karp-Rabin) hashes of the current length over the
words' own 64-bit hashes and then compared by these, word by word.  The share of the passage's words under tiles is its
coverage; the order of the tiles does not matter, so a reordered passage is caught.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import text as tx
from .tables import fresh, stored

#: Words of the shortest tile.
RUN = 5
#: A tile of this many words is a find by itself, however long the passage.
LONG = 13
#: Blocks of the benchmark that one pass over the documents holds in memory.
BLOCKS = 4


def _running(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    up, down = tx._powers(tx.BASE, len(hashes) + 1), tx._powers(pow(tx.BASE, -1, 1 << 64), len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], dtype=np.uint64, out=total[1:])
    return tx.mix((total[n:] - total[:-n]) * down[:k])


def _free_runs(free: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of ``n`` words from each place is free."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return taken[n:] == taken[:-n] if len(free) >= n else np.zeros(0, bool)


class _Matches:
    """Free runs of ``n`` words that two sequences share, found one at a time."""

    def __init__(self, a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, n: int):
        self.a, self.b, self.n = a, b, n
        ha, hb = _running(a, n), _running(b, n)
        at, pb = np.flatnonzero(_free_runs(free_a, n)), np.flatnonzero(_free_runs(free_b, n))
        self.order = pb[np.argsort(hb[pb], kind="stable")]
        keys = hb[self.order]
        first = np.searchsorted(keys, ha[at], side="left")
        self.last = np.searchsorted(keys, ha[at], side="right")
        hit = first < self.last
        self.at, self.first, self.last = at[hit], first[hit], self.last[hit]

    def of(self, k: int, begin: int, free: Callable[[int], bool]) -> tuple[int, int] | None:
        """The first place of the second sequence, from rank ``begin`` on, that agrees word for word
        with the k-th run and is ``free``, after the rank where it stands."""
        i = int(self.at[k])
        for rank in range(begin, int(self.last[k])):
            j = int(self.order[rank])
            if free(j) and np.array_equal(self.a[i:i + self.n], self.b[j:j + self.n]):
                return rank, j
        return None

    def any(self) -> bool:
        return any(self.of(k, int(self.first[k]), lambda j: True) for k in range(len(self.at)))


def tiles(test: np.ndarray, doc: np.ndarray, least: int = RUN) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word-hash sequences: (start in test, start in doc, words) of each tile.

    Equal lengths are taken in the order of the test's, then the document's places.  A
    test of fewer than ``least`` words has one tile, itself, or none.
    """
    least = max(1, min(least, len(test)))
    free_a, free_b = np.ones(len(test), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    high = min(len(test), len(doc))
    while high >= least:
        # the longest length with a common free run, by halving: a run of n has one of n - 1
        low, best = least, None
        while low <= high:
            n = (low + high) // 2
            found = _Matches(test, doc, free_a, free_b, n)
            if found.any():
                low, best = n + 1, found
            else:
                high = n - 1
        if best is None:
            break
        size, begin = best.n, {}
        for k, i in enumerate(best.at.tolist()):
            if not free_a[i:i + size].all():
                continue
            # a place once covered stays so: equal runs of the test go on where the last one stopped
            group = int(best.first[k])
            hit = best.of(k, begin.get(group, group), lambda j: free_b[j:j + size].all())
            begin[group] = hit[0] if hit else int(best.last[k])
            if hit:
                free_a[i:i + size] = free_b[hit[1]:hit[1] + size] = False
                out.append((i, hit[1], size))
        high = size
    return out


class Passages:
    """One block of the benchmark: its words, and the runs that seed a comparison."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        rows, words = tx.word_hashes(*tx.buffers(pa.array(texts, pa.string())))
        cuts = np.searchsorted(rows, np.arange(len(ids) + 1))
        self.words = [words[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        seeds: dict[int, dict[int, list[int]]] = {}
        for k, w in enumerate(self.words):
            n = min(RUN, len(w))
            if n:
                for s in np.unique(_running(w, n)).tolist():
                    seeds.setdefault(n, {}).setdefault(s, []).append(k)
        self.seeds = seeds
        self.front = {n: tx.HashSet(np.array(list(s), np.uint64)) for n, s in seeds.items()}

    def compare(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, list]]:
        """(row, passage, its words, tiles) of each document and passage that share a seed."""
        for a, b in tx.blocks(offsets):
            rows, words = tx.word_hashes(data, offsets[a:b + 1])
            pairs: set[tuple[int, int]] = set()
            for n, front in self.front.items():
                # the same hash as _running: shared seeds are looked up there
                run = _running(words, n)
                whole = rows[:len(run)] == rows[n - 1:] if len(run) else np.zeros(0, bool)
                at, _ = front.find(run)
                at = at[whole[at]]
                for r, h in {(r, h) for r, h in zip(rows[at].tolist(), run[at].tolist())}:
                    pairs.update((r, k) for k in self.seeds[n][h])
            cuts = np.searchsorted(rows, np.arange(b - a + 1)) if pairs else None
            for r, k in sorted(pairs):
                yield a + r, k, len(self.words[k]), tiles(self.words[k], words[cuts[r]:cuts[r + 1]])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[Row]]:
    """The benchmark's rows in blocks of bounded size, as they stream to the driver."""
    block, size = [], 0
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        block.append(row)
        size += len(row.text.encode()) + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCH = "struct<coverage: double, n_items: bigint, item_id: bigint, tiles: array<struct<test: int, doc: int, words: int>>>"


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, text: str = "text",
                   out: str = "match", block_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with column ``out``: the best coverage of any passage (0 without shared seed), the
    number of passages covered to ``threshold`` or more or by a tile of `LONG` words, the item with the best coverage
    (the smallest id of equals; null for none) and its tiles.

    The benchmark is a stated query set: it is taken in blocks of ``block_bytes``, each
    sent to all tasks; after every `BLOCKS` blocks what was found so far is stored, so
    memory is bounded and a larger benchmark takes more passes over the documents.
    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower
    case.  Null texts count as empty, and empty passages match nothing.  Rows are
    neither joined nor moved.
    """
    sc = docs.sparkSession.sparkContext
    columns = []
    for rows in _blocks(benchmark, block_bytes):
        sent = sc.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
        name = fresh(docs, f"_block{len(columns)}")
        docs = docs.withColumn(name, _match_column(sent, threshold)(F.col(text)))
        columns.append(name)
        if len(columns) % BLOCKS == 0:
            docs = stored(docs, "blocks")
    none = F.lit(None).cast(MATCH)
    found = [F.col(c) for c in columns] or [none]
    nonnull = F.filter(F.array(*found), lambda m: m.isNotNull())
    rank = F.transform(nonnull, lambda m: F.struct((-m["coverage"]).alias("c"), m["item_id"].alias("i"), m["tiles"].alias("t")))
    best = F.array_min(F.transform(rank, lambda m: F.struct(m["c"], m["i"], m["t"])))
    n = F.aggregate(nonnull, F.lit(0).cast("bigint"), lambda x, m: x + m["n_items"])
    return docs.withColumn(out, F.struct(F.coalesce(-best["c"], F.lit(0.0)).alias("coverage"), n.alias("n_items"),
                                         best["i"].alias("item_id"), best["t"].alias("tiles"))).drop(*columns)


def _match_column(sent, threshold: float):
    held: list[Passages] = []

    @F.arrow_udf(MATCH)
    def match(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Passages(*sent.value))
        best: list[dict | None] = [None] * len(texts)
        for row, k, n, found in held[0].compare(*tx.buffers(texts)):
            share = sum(t[2] for t in found) / n
            old = best[row]
            if old is None:
                old = best[row] = {"coverage": -1.0, "n_items": 0, "item_id": None, "tiles": []}
            old["n_items"] += share >= threshold or max((t[2] for t in found), default=0) >= LONG
            if share > old["coverage"]:  # passages come in the order of their ids
                old |= {"coverage": share, "item_id": held[0].ids[k],
                        "tiles": [{"test": i, "doc": j, "words": w} for i, j, w in found]}
        return pa.array(best, pa.struct([
            ("coverage", pa.float64()), ("n_items", pa.int64()), ("item_id", pa.int64()),
            ("tiles", pa.list_(pa.struct([("test", pa.int32()), ("doc", pa.int32()), ("words", pa.int32())])))]))

    return match


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in which no passage is covered to ``threshold`` or more or by a tile of `LONG` words, with their own columns only."""
    name = fresh(docs, "_match")
    kept = contaminations(docs, benchmark, threshold, out=name).where(F.col(name)["n_items"] == 0)
    return kept.select(*[f"`{c}`" for c in docs.columns])
