"""Phrase collocations by SON partitioning.

The documents are cut into shards.  A phrase that stands ``least`` times in the corpus
stands, in some shard, at least as often as that shard's share of the words asks for
(pigeonhole).  So each shard is mined completely at its lowered support, and the phrases that
are frequent in any shard are united.  Their counts in all shards are at hand by then, so those
that do not add up to ``least`` leave at once, before they let longer runs through.  A shard is
mined level by level: a run of k words is counted only if both of its runs of k - 1 words are
among the united candidates so far.

The number of shards is fixed, so the lowered support does not sink as the corpus grows; a
shard is as large as it has to be and is mined by many tasks, which add up their own counts
first.  Runs are counted by their 64-bit hashes, by language and number of words, and one more
pass brings the text of each: every task meets most frequent phrases, so a phrase is given out
only by the rows of one span of ids that it stands in, the least, which the counts carry along.
The candidates and their spans travel as bit tables of fixed size, indexed by hash: two phrases
that meet there cost a needless count or row and nothing else, as both are joined by the hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as tx
from .tables import stored

_byte = np.arange(256)
#: Words are runs of anything but space, tab and the separators of pieces.
SEPARATES = np.isin(_byte, [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
IN_WORD = (~(SEPARATES | np.isin(_byte, [0x20, 0x09]))).astype(np.uint8)

#: Runs that a task holds before it adds equal ones up.
HELD = 1 << 22
#: Consecutive ids that share a shard.
SPAN = 4096
#: Bits of the table of candidates, as a power of two (16 MB), and of one of its rows.
BITS, ROW_BITS = 27, 16


class Words:
    """The words of some rows in text order: row, piece and hash of each, and on request their text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, with_text: bool):
        first = int(offsets[0])
        data, offsets = data[first:int(offsets[-1])], offsets - first
        bounds = np.union1d(offsets, np.flatnonzero(SEPARATES[data]) + 1)
        self.piece, self.hash = tx.word_hashes(data, bounds, IN_WORD)
        self.row = np.searchsorted(offsets, bounds[self.piece], side="right") - 1
        if with_text:
            starts, ends = tx.word_spans(data, IN_WORD, bounds)
            # all words one after the other, a space after each
            size = ends - starts + 1
            self.end = np.cumsum(size) - 1
            self.start = self.end + 1 - size
            self.text = tx.LOWER[data[np.minimum(_ranges(starts, size), max(len(data) - 1, 0))]] if len(size) else data[:0]
            self.text[self.end] = 32

    def runs(self, k: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``k`` words of one piece; ``seeds`` by row tell languages apart."""
        at, h = tx.shingles(self.piece, self.hash, k)
        return at, tx.mix(h ^ (seeds[self.row[at]] + np.uint64(k)))


@dataclass(frozen=True)
class Candidates:
    """Bit tables of the candidates: of their hashes, and of the spans that give out their text."""

    hashes: Broadcast
    spans: Broadcast

    @property
    def value(self) -> np.ndarray:
        return self.hashes.value


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them."""
    ends = np.cumsum(sizes)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(out):
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
    return np.cumsum(out)


def _parts(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray, dict, Words]]:
    """Blocks of rows: the languages met, each row's number among these and its hash seed, its shard and span if given, the words."""
    for batch in batches:
        data, offsets = tx.buffers(batch.column("text"))
        keyed = batch.column("lang").dictionary_encode()
        langs, codes = keyed.dictionary.to_pylist(), keyed.indices.to_numpy(zero_copy_only=False)
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), 9) for x in langs], np.uint64)[codes]
        places = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "span") if c in batch.schema.names}
        for a, b in tx.blocks(offsets):
            yield langs, codes[a:b], seeds[a:b], {c: x[a:b] for c, x in places.items()}, Words(
                data, offsets[a:b + 1], with_text)


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    place = hashes >> np.uint64(64 - BITS)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _in_span(hashes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Hashes of runs, each with a span; both halves of one are bits of the table of spans."""
    return tx.mix(hashes ^ tx.mix(spans.astype(np.uint64)))


def _mined(docs: DataFrame, k: int, below) -> DataFrame:
    """lang, shard, h, n, span: how often each run of ``k`` words whose parts are candidates stands in each shard,
    by its hash, and a span of ids that it stands in; a hash's shards are in one partition."""
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, shard), parts in held.items():
                h, span = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(h)
                h = h[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                n, h, span = np.diff(first, append=len(h)), h[first].view(np.int64), span[order[first]]
                for a in range(0, len(h), 1 << 18):
                    part = h[a:a + (1 << 18)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]).take(pa.array(np.zeros(len(part), np.int32))),
                         pa.array(np.full(len(part), shard, np.int32)), pa.array(part),
                         pa.array(n[a:a + (1 << 18)]), pa.array(span[a:a + (1 << 18)])],
                        names=["lang", "shard", "h", "n", "span"])
            held.clear()

        for langs, codes, seeds, places, words in _parts(batches, False):
            at, h = words.runs(k, seeds)
            if k > 1:
                first, parts = words.runs(k - 1, seeds)
                known = np.zeros(len(words.hash) + 1, bool)
                known[first] = _has(below.value, parts)
                good = known[at] & known[at + 1]
                at, h = at[good], h[good]
            row = words.row[at]
            group, span = codes[row].astype(np.int64) << 32 | places["shard"][row], places["span"][row]
            order = np.argsort(group, kind="stable") if len(group) and (group != group[0]).any() else slice(None)
            group, h, span = group[order], h[order], span[order]
            cuts = np.flatnonzero(np.diff(group)) + 1
            for part, spans, a in zip(np.split(h, cuts), np.split(span, cuts), [0, *cuts.tolist()]):
                if len(part):
                    held.setdefault((langs[int(group[a]) >> 32], int(group[a]) & 0xFFFFFFFF), []).append((part, spans))
            size += len(h)
            if size >= HELD:
                yield from flush()
                size = 0
        yield from flush()

    return (docs.mapInArrow(mine, "lang string, shard int, h bigint, n bigint, span int").repartition("lang", "h")
            .groupBy("lang", "shard", "h").agg(F.sum("n").alias("n"), F.min("span").alias("span")))


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """The bits of all hashes (column h, their upper halves): rows of 8 KB are filled in tasks, the driver puts them together."""
    row_bits, rows = ROW_BITS, 1 << (BITS - ROW_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place = np.unique(np.asarray(batch.column("h")).view(np.uint32) >> np.uint32(32 - BITS)).astype(np.uint64)
            row = (place >> np.uint64(row_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(row)) + 1
            for part in np.split(place, cuts) if len(place) else []:
                at = (part & np.uint64((1 << row_bits) - 1)).astype(np.int64)
                bits = held.setdefault(int(part[0] >> np.uint64(row_bits)), np.zeros(1 << (row_bits - 3), np.uint8))
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for r, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([bits.tobytes()])], names=["row", "bits"])

    table = np.zeros((rows, 1 << (row_bits - 3)), np.uint8)
    placed = hashes.select("h").repartition(F.shiftrightunsigned("h", 32 - BITS + row_bits))
    for r in placed.mapInArrow(fill, "row int, bits binary").collect():  # 16 MB at most
        table[r.row] |= np.frombuffer(r.bits, np.uint8)
    return table.reshape(-1)


def _span_halves(found: DataFrame) -> DataFrame:
    """h: both halves of every candidate's hash with its span."""
    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _in_span(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64),
                         batch.column("span").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h).view(np.int32))], names=["h"])

    return found.select("h", "span").mapInArrow(halves, "h int")


def _counted(docs: DataFrame, most: int, known: Candidates) -> DataFrame:
    """lang, k, h, phrase: the text of the runs of 1 to ``most`` words whose bit is set, from the rows of their span."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _task_counts(batches, most, known.value, known.spans.value)

    return (docs.select("lang", "text", "span")
            .mapInArrow(count, "lang string, k int, h bigint, phrase string, n bigint")
            .groupBy("lang", "k", "h").agg(F.min("phrase").alias("phrase")))


def _task_counts(batches: Iterator[pa.RecordBatch], most: int, table: np.ndarray, spans: np.ndarray | None = None
                 ) -> Iterator[pa.RecordBatch]:
    """The counts of one task's rows, with ``spans`` only of the runs that stand in their own span.  Equal runs are added up whenever much is held, and only what is
    too much even then is given out before the end.  A run counts only if both of its runs of one word
    less do: they are as frequent, so the table's false bits let few others through."""
    held: dict[tuple, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, k), parts in held.items():
            h, n, start, length, text = _added(parts)
            yield from _phrases(lang, k, h, n, start, length, text)
        held.clear()

    for langs, codes, seeds, places, words in _parts(batches, True):
        below = np.ones(len(words.hash) + 1, bool)
        for k in range(1, most + 1):
            at, h = words.runs(k, seeds)
            if k > 1:
                good = below[at] & below[at + 1]
                at, h = at[good], h[good]
            good = _has(table, h)
            at, h = at[good], h[good]
            below = np.zeros(len(words.hash) + 1, bool)
            below[at] = True
            if spans is not None:
                own = _in_span(h, places["span"][words.row[at]])
                good = _has(spans, own) & _has(spans, own << np.uint64(32))
                at, h = at[good], h[good]
            code = codes[words.row[at]]
            for c in np.unique(code).tolist():
                own = code == c
                u, first, n = np.unique(h[own], return_index=True, return_counts=True)
                at_c = at[own][first]
                start, length = words.start[at_c], words.end[at_c + k - 1] - words.start[at_c]
                text = words.text[_ranges(start, length)]
                held.setdefault((langs[c], k), []).append((u, n, np.cumsum(length) - length, length, text))
                size += len(u) + len(text) // 8
        if size >= HELD:
            for key, parts in held.items():
                held[key] = [_added(parts)]
            size = sum(len(h) + len(text) // 8 for [(h, _n, _start, _length, text)] in held.values())
            if size >= HELD // 2:
                yield from flush()
                size = 0
    yield from flush()


def _added(parts: list[tuple]) -> tuple:
    """Parts of hash, count, start and length of runs and their text as one part, equal runs added up."""
    h, n, start, length, texts = (np.concatenate(x) if i < 4 else x for i, x in enumerate(zip(*parts)))
    shift = np.cumsum([0, *map(len, texts)])[:-1]
    start = start + np.repeat(shift, [len(p[0]) for p in parts])
    h, first, place = np.unique(h, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, place, n)
    length = length[first]
    return h, total, np.cumsum(length) - length, length, np.concatenate(texts)[_ranges(start[first], length)]


def _phrases(lang: str, k: int, h: np.ndarray, n: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray
             ) -> Iterator[pa.RecordBatch]:
    """Rows of lang, k, h, phrase and n, in batches."""
    for a in range(0, len(n), 1 << 17):
        s, size = start[a:a + (1 << 17)], length[a:a + (1 << 17)]
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        phrase = pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(ends.tobytes()),
                                                             pa.py_buffer(text[_ranges(s, size)].tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang]).take(pa.array(np.zeros(len(s), np.int32))), pa.array(np.full(len(s), k, np.int32)),
             pa.array(h[a:a + (1 << 17)].view(np.int64)), phrase, pa.array(n[a:a + (1 << 17)])],
            names=["lang", "k", "h", "phrase", "n"])


def frequent_phrases(docs: DataFrame, least: int, most: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of 1 to ``most`` words that stand ``least`` times or more
    in one language, and (lang, total), the words of each language.

    ``docs`` has doc_id, lang and text without nulls in the last two.
    """
    sc = docs.sparkSession.sparkContext
    span = F.floor(F.col("doc_id") / SPAN)
    shard = F.pmod(F.xxhash64(span), F.lit(shards)).cast("int")
    parted = docs.select("lang", "text", F.coalesce(shard, F.lit(0)).alias("shard"),
                         F.coalesce(F.pmod(span, F.lit((1 << 31) - 1)).cast("int"), F.lit(0)).alias("span"))
    words = stored(_mined(parted, 1, None), "words")
    sizes = words.groupBy("lang", "shard").agg(F.sum("n").alias("own"))
    totals = stored(sizes.join(sizes.groupBy("lang").agg(F.sum("own").alias("total")), "lang"), "totals")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    every, table, levels = np.zeros(1 << (BITS - 3), np.uint8), None, []
    for k in range(1, most + 1):
        counts = words if k == 1 else _mined(parted, k, table)
        local = exact("n") * exact("total") >= exact("own") * F.lit(least)
        whole = counts.join(totals, ["lang", "shard"]).groupBy("lang", "h").agg(
            F.sum("n").alias("f"), F.max(local).alias("local"), F.min("span").alias("span"))
        levels.append(stored(whole.where(F.col("local") & (F.col("f") >= least))
                             .select("lang", F.lit(k).alias("k"), "h", "f", "span"), "candidates"))
        found = _bit_table(levels[-1].select(F.shiftright("h", 32).cast("int").alias("h")))
        if table is not None:
            table.unpersist()
        if not found.any():
            break
        every |= found
        table = sc.broadcast(found)
    found = reduce(DataFrame.union, levels)
    known = Candidates(sc.broadcast(every), sc.broadcast(_bit_table(_span_halves(found))))
    phrases = stored(found.join(_counted(parted, most, known), ["lang", "k", "h"]).select("lang", "k", "phrase", "f"), "phrases")
    return phrases, totals.select("lang", "total").distinct()


def _words_of(phrase: Column, start: int, size: Column) -> Column:
    """``size`` words from word ``start`` on (from 1)."""
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(start), size), " ")


def collocations(docs: DataFrame, least: int = 100, most: int = 5, covered: int = 100, top: int = 2000,
                 shards: int = 8) -> DataFrame:
    """The ``top`` phrases of 2 to ``most`` words of each language by how far they exceed chance.

    A-Z are lowered; texts (null: empty) are cut at ``. , ; : ! ?`` and line ends into
    pieces, these at spaces and tabs into words.  Per lang (null: ``und``): a is the number of
    a phrase's occurrences inside pieces, overlaps included; ``least`` are needed.  Cutting
    it after its first words into parts with l and r occurrences gives floor(1000 a n /
    (l r)), n the language's words, in exact decimals; the lowest cut counts, the first of
    equals.  A phrase inside a longer one that has ``covered`` percent of its occurrences
    or more is left out.  lang, rank, phrase, a, l, r, n, score; ranks go by score and a,
    descending, then by the phrase's bytes.  Repeated rows count each time; an empty table,
    or one without frequent phrases, gives no rows.
    """
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"),
                        F.coalesce("text", F.lit("")).alias("text"))
    phrases, totals = frequent_phrases(plain, least, most, shards)
    long = phrases.where("k >= 2")
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))
    cut = (long.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
           .withColumns({"left": _words_of(F.col("phrase"), 1, F.col("cut")),
                         "right": F.array_join(F.slice(F.split("phrase", " "), F.col("cut") + 1, F.col("k")), " ")}))
    both = (cut.join(part.select("lang", F.col("part").alias("left"), F.col("count").alias("l")), ["lang", "left"])
            .join(part.select("lang", F.col("part").alias("right"), F.col("count").alias("r")), ["lang", "right"])
            .join(totals, "lang"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast((cast(a as decimal(19,0)) * cast(total as decimal(19,0)) * 1000BD) "
                   "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")
    scored = (both.withColumn("score", score).groupBy("lang", "phrase", "k")
              .agg(F.min(F.struct("score", "cut", "l", "r", "a", "total")).alias("c"))
              .select("lang", "phrase", "c.a", "c.l", "c.r", F.col("c.total").alias("n"), "c.score"))
    # a longer phrase over the limit means one that is longer by one word, for counts only sink
    inner = (long.where("k >= 3").select("lang", "f", F.explode(F.array(
        _words_of(F.col("phrase"), 1, F.col("k") - 1), _words_of(F.col("phrase"), 2, F.col("k") - 1))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * covered)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)))
    best = (kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order)))
            .where(F.col("rank") <= top))
    return (best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
