"""Toxicity by a factorization machine over hashed terms.

Terms are whole words and 5-byte windows of words, as 64-bit hashes; a document has a
term or has it not.  The machine learns the terms whose documents its earlier rounds misjudge.  The machine adds to a linear weight per term the product of two
short factors for every pair of terms in the document, so that an insult beside a group
mention can count for more than the two apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import labelled_sample


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every word and window, repeats included."""
    r1, h1 = tx.word_hashes(data, offsets)
    r2, h2 = tx.byte_grams(data, offsets)
    return np.concatenate([r1, r2]), np.concatenate([h1, h2])


def _distinct(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    return rows[new], terms[new]


@dataclass
class Machine:
    """A trained machine; ``terms`` sorted, one weight and one factor row for each."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def constant(cls, share: float) -> Machine:
        """A machine without terms: every text has the score ``share``, kept off 0 and 1."""
        p = min(max(share, 1e-3), 1 - 1e-3)
        return cls(np.zeros(0, np.uint64), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, 1)))

    def scores(self, data: np.ndarray, offsets: np.ndarray, known: tx.HashSet) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for a, b in tx.blocks(offsets):
            rows, terms = _terms(data, offsets[a:b + 1])
            at, place = known.find(terms)
            row, place = _distinct(rows[at], place)
            out[a:b] = self.logits(row, place, b - a)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    def logits(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(rows, weights=self.weights[places], minlength=n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[places, f]
            pairs += np.bincount(rows, weights=v, minlength=n) ** 2 - np.bincount(rows, weights=v * v, minlength=n)
        return self.bias + linear + 0.5 * pairs


def fit(rows: np.ndarray, places: np.ndarray, y: np.ndarray, terms: np.ndarray, factors: int = 8,
        epochs: int = 25, batch: int = 512, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Adam on the log loss; ``rows``/``places`` list the terms each document has, sorted by row."""
    rng = np.random.default_rng(seed)
    n, m = len(y), len(terms)
    starts = np.searchsorted(rows, np.arange(n + 1))
    p = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    params = [np.array([np.log(p / (1 - p))]), np.zeros(m), rng.normal(0, 0.01, (m, factors))]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    step = 0
    for _ in range(epochs if m and n else 0):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            docs = order[at:at + batch]
            size = starts[docs + 1] - starts[docs]
            x = np.zeros((len(docs), m), np.float32)
            x[np.repeat(np.arange(len(docs)), size),
              places[np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])]] = 1
            bias, w, v = (q.astype(np.float32) for q in params)
            xv = x @ v
            z = bias[0] + x @ w + 0.5 * ((xv ** 2).sum(1) - x @ (v ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[docs]).astype(np.float32) / len(docs)
            gx = x * g[:, None]
            grads = [np.array([g.sum()]), x.T @ g + decay * w,
                     x.T @ (g[:, None] * xv) - gx.sum(0)[:, None] * v + decay * v]
            step += 1
            for q, d, a, b in zip(params, grads, first, second):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                q -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return Machine(terms, float(params[0][0]), params[1], params[2])


#: Steps per one in the sums of residuals and variances, which are whole numbers and so exact.
STEPS = 1 << 20


def _surprise(machine: Machine, floor: float):
    """Per term: documents that have it, their residuals (label less score) and their variances added up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tx.HashSet(machine.terms)
        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            y = np.asarray(batch.column("y"))
            for a, b in tx.blocks(offsets):
                p = machine.scores(data, offsets[a:b + 1], known)
                rows, terms = _distinct(*_terms(data, offsets[a:b + 1]))
                ids, inverse = np.unique(terms, return_inverse=True)
                sums = [np.bincount(inverse, weights=np.rint(x[rows] * STEPS), minlength=len(ids)).astype(np.int64)
                        for x in (y[a:b] - p, np.maximum(p * (1 - p), floor))]
                n = np.bincount(inverse, minlength=len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n), *map(pa.array, sums)],
                                                 names=["term", "n", "r", "v"])

    return count


def _informative(sample: DataFrame, machine: Machine, floor: float, least_docs: int, least: float) -> np.ndarray:
    """Terms whose documents ``machine`` misjudges on one side: r^2 / v of ``least`` or more."""
    sums = (sample.select("y", "text").mapInArrow(_surprise(machine, floor), "term bigint, n bigint, r bigint, v bigint")
            .groupBy("term").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("v").alias("v")))
    best = sums.where((F.col("n") >= least_docs) & (F.pow(F.col("r").cast("double"), F.lit(2)) >= least * STEPS * F.col("v")))
    return best.select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64)


def _training_rows(sample: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``terms``) of what each sample document has, and the labels."""
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tx.HashSet(terms)
        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            for a, b in tx.blocks(offsets):
                rows, found = _terms(data, offsets[a:b + 1])
                at, place = known.find(found)
                row, place = _distinct(rows[at], place)
                ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("y").slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))],
                    names=["doc_id", "y", "has"])

    kept = (sample.mapInArrow(present, "doc_id bigint, y int, has array<int>")
            .orderBy(F.xxhash64("doc_id"), "doc_id").select("y", "has").toArrow())
    has = kept.column("has").combine_chunks()
    flat = has.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.asarray(has.value_lengths().fill_null(0)).astype(np.int64)
    y = kept.column("y").to_numpy().astype(float)
    return np.repeat(np.arange(len(y)), sizes), flat, y


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, bound: int = 20_000, rounds: int = 3,
          least_docs: int = 3, least: float = 15.0) -> Machine:
    """Fit a machine to ``labels.toxic`` on at most ``bound`` labelled documents.

    An id that several rows repeat counts as one document.  Terms enter in ``rounds``: each
    asks which terms, in ``least_docs`` documents or more, the machine so far misjudges,
    toxic or benign: the square of their documents' summed residuals, over the summed
    variances (half the variance of the toxic share at least), is ``least`` or more.  Then the
    machine is fitted anew to all terms so far.  So two words that
    are toxic only together come in as soon as the machine explains what else is toxic,
    and their factors learn the product.  There is no limit on the number of terms; the driver
    receives which of them each sample document has.  Without labels, or without such
    terms, every text gets the share of toxic labels (a half if there are none).
    """
    sample = labelled_sample(docs.sparkSession, docs, labels, "toxic", bound, train_rows)
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = toxic / total if total else 0.5
    machine = Machine.constant(share)
    for _ in range(rounds):
        found = np.setdiff1d(_informative(sample, machine, share * (1 - share) / 2, least_docs, least), machine.terms)
        if not len(found):
            break
        terms = np.union1d(machine.terms, found)
        machine = fit(*_training_rows(sample, terms), terms)
    return machine


def score_column(text: Column, machine: Machine) -> Column:
    """Probability of toxicity of each whole text; null counts as empty."""
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = tx.HashSet(machine.terms)
        for part in texts:
            yield pa.array(machine.scores(*tx.buffers(part), known))

    return score(text)
