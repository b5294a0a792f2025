"""Language-model scores from a lattice of subwords.

The vocabulary of an existing subword model is taken as the alphabet of a unigram model:
a text is a sequence of pieces and an end mark, and its probability is the sum over all
segmentations of the product of piece probabilities.  No piece goes beyond a word, so
the sum is a product over words, and one forward recursion in log space per distinct
word serves the whole corpus.

The piece probabilities start from the vocabulary's own scores and are re-estimated on
the training words by expectation-maximisation; the word counts, the expected piece
counts and the scores of all distinct words are Spark jobs over the whole corpus.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import stored

NEVER = -np.inf


class Pieces:
    """The surfaces of a vocabulary, as bytes with one space for the word mark, found by hashes of their ends."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        start: dict[bytes, float] = {bytes([b]): NEVER for b in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)):
                surface = sp.id_to_piece(i).replace("▁", " ").encode()
                if surface.rfind(b" ") <= 0:  # a mark elsewhere never occurs in a word
                    start[surface] = sp.get_score(i)
        self.surfaces = list(start)
        self.scores = np.array([start[s] for s in self.surfaces])
        ends: dict[int, int] = {}
        power = [pow(tx.BASE, k, 1 << 64) for k in range(max(map(len, self.surfaces)))]
        for n, s in enumerate(self.surfaces):
            h = 0
            for k in range(len(s)):
                h = (h + int(tx._VALUE[s[-1 - k]]) * power[k]) & tx.MASK
                ends.setdefault(h, -1)
            ends[h] = n
        self.power = power
        self.ends = tx.HashSet(np.array(list(ends), np.uint64))
        self.piece_of = np.array([ends[int(h)] for h in self.ends.members])

    def first_guess(self) -> np.ndarray:
        """Probabilities from the vocabulary's scores: those of a merge vocabulary are ranks, so
        1 / (2 + rank); the other bytes come last.  Scores that are log probabilities are taken as such."""
        known = self.scores[np.isfinite(self.scores)]
        if len(known) and known.min() > -50:
            p = np.where(np.isfinite(self.scores), np.exp(self.scores), np.exp(known.min()))
        else:
            rank = np.where(np.isfinite(self.scores), -self.scores, len(self.scores))
            p = 1 / (2 + rank)
        return p / p.sum()


class Lattice:
    """All pieces that end at each byte of some words, each preceded by a word mark."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        flat = np.frombuffer(b" " + b" ".join(words), np.uint8)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.ends = np.cumsum(self.lengths)
        begin = self.ends - self.lengths
        depth = np.arange(len(flat)) - np.repeat(begin, self.lengths) + 1  # bytes of the word up to here
        active, h = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
        at, size, piece = [], [], []
        for k, power in enumerate(pieces.power):
            h = h + tx._VALUE[flat[active - k]] * np.uint64(power)
            found, place = pieces.ends.find(h)
            active, h = active[found], h[found]
            own = pieces.piece_of[place]
            hit = own >= 0
            at.append(active[hit])
            size.append(np.full(int(hit.sum()), k + 1))
            piece.append(own[hit])
            more = depth[active] > k + 1
            active, h = active[more], h[more]
            if not len(active):
                break
        at, size, piece = np.concatenate(at), np.concatenate(size), np.concatenate(piece)
        order = np.lexsort((at, depth[at]))
        self.at, self.size, self.piece = at[order], size[order], piece[order]
        self.word = np.searchsorted(self.ends, self.at, side="right")
        # node 0 of a word is the place before it; nodes are shifted by the word's number
        self.to = self.at + self.word + 1
        self.start = self.to - self.size
        self.n = len(flat) + len(words)
        self.first = begin + np.arange(len(words))
        self.last = self.first + self.lengths
        self.levels = np.searchsorted(depth[self.at], np.arange(1, depth.max() + 2)) if len(flat) else np.zeros(1, int)

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        alpha = np.full(self.n, NEVER)
        alpha[self.first] = 0.0
        for a, b in zip(self.levels[:-1], self.levels[1:]):
            value = alpha[self.start[a:b]] + log_p[self.piece[a:b]]
            to = self.to[a:b]
            new = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            alpha[to[new]] = np.logaddexp.reduceat(value, new)
        return alpha

    def expected(self, log_p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each taken ``counts`` times."""
        alpha = self.forward(log_p)
        beta = np.full(self.n, NEVER)
        beta[self.last] = 0.0
        for a, b in zip(self.levels[-2::-1], self.levels[:0:-1]):
            np.logaddexp.at(beta, self.start[a:b], beta[self.to[a:b]] + log_p[self.piece[a:b]])
        share = np.exp(alpha[self.start] + log_p[self.piece] + beta[self.to] - alpha[self.last][self.word])
        return np.bincount(self.piece, weights=share * counts[self.word], minlength=len(log_p))


def _batches(words: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of words of up to ``limit`` bytes together; a longer word is alone."""
    at = size = 0
    for k, w in enumerate(words):
        if size and size + len(w) > limit:
            yield at, k
            at, size = k, 0
        size += len(w) + 1
    if at < len(words):
        yield at, len(words)


@dataclass
class LatticeModel:
    """A trained model: ``words`` (word, c, lp: natural log of its marginal probability) is a stored table."""

    words: DataFrame
    tokens: int
    vocabulary: int
    train_docs: int
    end_lp: float
    log_p: np.ndarray

    def base(self, c: float) -> float:
        return float(np.log10((c + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1))))


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the batches with their counts in training texts; held-out words count zero."""
    known: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in known], pa.string()),
                                            pa.array(list(known.values()), pa.int64())], names=["word", "c"])
        known.clear()
        return batch

    for batch in batches:
        held = batch.column("held_out").to_pylist()
        for k, t in enumerate(batch.column("text").fill_null("").cast(pa.large_binary())):
            words = _words(t.as_py())
            if held[k]:
                for w in set(words):
                    known.setdefault(w, 0)
            else:
                known.update(words)
            if len(known) > 300_000:
                yield out()
    if known:
        yield out()


def train(docs: DataFrame, held_out: Column, model: bytes, rounds: int = 2, smoothing: float = 0.1) -> LatticeModel:
    """Learn word counts and piece probabilities from the rows of ``docs`` that are not ``held_out``.

    Null texts count as empty.  Only numbers per vocabulary piece come to the driver.
    Without training text the vocabulary's own scores stand, and an end is sure.
    """
    pieces, name = Pieces(model), "pieces" + hashlib.sha256(model).hexdigest()
    marked = docs.select("text", held_out.alias("held_out"))
    words = stored(marked.mapInArrow(_count_words, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")),
                   "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    train_docs = marked.where(~F.col("held_out")).count()
    p, end = pieces.first_guess(), 1.0
    seen = words.where("c > 0")
    for _ in range(rounds if total else 0):
        with np.errstate(divide="ignore"):
            log_p = np.log(p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sums = tx.per_process(name, lambda: Pieces(model)), np.zeros(len(log_p))
            for batch in batches:
                texts = [w.as_py() for w in batch.column("word").cast(pa.large_binary())]
                counts = np.asarray(batch.column("c")).astype(float)
                for a, b in _batches(texts):
                    sums += Lattice(own, texts[a:b]).expected(log_p, counts[a:b])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["piece", "n"])

        got = (seen.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
               .toPandas())
        n = np.zeros(len(p))
        n[got["piece"].to_numpy()] = got["n"].to_numpy()
        n += smoothing
        p = n / (n.sum() + train_docs)
        end = train_docs / (n.sum() + train_docs)
    log_p = np.log(p)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tx.per_process(name, lambda: Pieces(model))
        for batch in batches:
            texts = [w.as_py() for w in batch.column("word").cast(pa.large_binary())]
            lp = np.empty(len(texts))
            for a, b in _batches(texts):
                lattice = Lattice(own, texts[a:b])
                lp[a:b] = lattice.forward(log_p)[lattice.last]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lp)],
                                             names=["word", "c", "lp"])

    scored = stored(words.mapInArrow(score, "word string, c bigint, lp double"), "scored")
    return LatticeModel(scored, total + train_docs, distinct + (train_docs > 0), train_docs,
                        float(np.log(end)), log_p)


def score(docs: DataFrame, held_out: Column, model: LatticeModel, frequent: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    Tokens are the words and one end.  base_score: sum of log10((c + 0.5) / (N + 0.5 (V + 1)));
    score: the model's log10 probability of the text, its end included.  The model's words must
    cover the texts, as they do if it was trained on ``docs``.

    The ``frequent`` commonest words of up to 64 bytes (a fixed bound on what is broadcast) are
    looked up where the text is; all others go through a join on the word.
    """
    sc = docs.sparkSession.sparkContext
    top = (model.words.where(F.octet_length("word") <= 64).orderBy(F.desc("c"), "word").limit(frequent)
           .select("word", "c", "lp").toPandas())
    hot = sc.broadcast({w.encode(): (int(c > 0), model.base(c), lp)
                        for w, c, lp in zip(top["word"], top["c"], top["lp"])})
    end_known, end_base, end_lp = int(model.train_docs > 0), model.base(model.train_docs), model.end_lp
    rest = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = hot.value.get
        for batch in batches:
            out: list[tuple] = []
            for t in batch.column("text").fill_null("").cast(pa.large_binary()):
                words = _words(t.as_py())
                known, base, lp, other = end_known, end_base, end_lp, []
                for w, n in Counter(words).items():
                    if (found := get(w)) is not None:
                        known += n * found[0]
                        base += n * found[1]
                        lp += n * found[2]
                    else:
                        other.append({"word": w.decode(), "n": n})
                out.append((len(words) + 1, known, base, lp, other))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"),
                 *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp", "rest"])

    marked = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                         held_out.alias("held_out"), "text")
    partials = stored(marked.mapInArrow(
        partial, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, "
                 "lp double, rest array<struct<word: string, n: bigint>>"), "partials")
    others = partials.select("row", F.inline("rest")).join(model.words, "word")
    width = F.lit(model.tokens + 0.5 * (model.vocabulary + 1))
    sums = others.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / width)).alias("more_base"),
        F.sum(F.col("n") * F.col("lp")).alias("more_lp"))
    nought = F.lit(0)
    return partials.drop("rest").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", nought)).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", nought)).alias("base_score"),
        ((F.col("lp") + F.coalesce("more_lp", nought)) / float(np.log(10))).alias("score"))
