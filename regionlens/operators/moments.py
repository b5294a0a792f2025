"""Cross-product sums of many columns in one pass.

Each task turns its batches into a matrix of values and one of presence and multiplies
column blocks of them, upper triangle only: for every pair of columns the rows where both
are present, and over these the sums of either, of the products and of the squares.  A task
sends one row per pair of blocks; these are added up by block pair.  What follows is
arithmetic on a few small matrices:

* correlations with pairwise-complete rows (A7);
* linear models: per group (a cross-validation fold, a masking level) the sums are a table
  of sufficient statistics, the sums of all other groups are total minus group, so every
  training fold and every penalty is a small solve, and squared errors are quadratic forms.

Columns are shifted by the mean of a few rows first, so that large offsets do not cancel.
NULL and NaN count as missing.  A task holds 16 bytes per group and pair of columns, twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block.
BLOCK = 128
_PART = "g bigint, a int, b int, s array<double>"


@dataclass
class Sums:
    """Sums over some rows, by pair of columns (i, j): n rows with both; over these x = sum of
    column i, q = sum of its squares, p = sum of products.  ``shift`` was taken off each column."""

    shift: np.ndarray
    n: np.ndarray
    x: np.ndarray
    q: np.ndarray
    p: np.ndarray

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.shift, self.n - other.n, self.x - other.x, self.q - other.q, self.p - other.p)

    def correlations(self) -> np.ndarray:
        """Pearson's r of every pair; NaN with fewer than two rows or without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = self.n * self.p - self.x * self.x.T
            var = np.maximum(self.n * self.q - self.x ** 2, 0)
            r = cov / np.sqrt(var * var.T)
        return np.where((self.n >= 2) & (var > 0) & (var.T > 0), np.clip(r, -1, 1), np.nan)

    # ------------------------------------------------ complete rows only: all of n are equal

    @property
    def rows(self) -> int:
        return int(self.n[0, 0])

    def means(self) -> np.ndarray:
        return self.shift + np.diag(self.x) / max(self.rows, 1)

    def cov(self) -> np.ndarray:
        """Population covariances."""
        n, x = max(self.rows, 1), np.diag(self.x)
        return (self.p - np.outer(x, x) / n) / n

    def solve(self, penalty: float = 0.0, scale: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Coefficients and intercept of the last column on the others: least squares with
        ``penalty`` times the squared coefficients, in units of the mean squared error, on
        columns divided by ``scale``.  Columns that are constant or depend on others get the
        shortest solution."""
        c, mean = self.cov(), self.means()
        s, k = c[:-1, :-1], c[:-1, -1]
        unit = np.ones(len(k)) if scale is None else np.where(scale > 0, scale, 1.0)
        a, b = s / np.outer(unit, unit) + penalty * np.eye(len(k)), k / unit
        size = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        w = np.linalg.lstsq(a / np.outer(size, size), b / size, rcond=1e-12)[0] / size / unit
        return w, float(mean[-1] - w @ mean[:-1])

    def squared_error(self, w: np.ndarray, intercept: float) -> float:
        """Sum of squared residuals of these rows under a linear model."""
        v = np.append(-w, 1.0)
        offset = float(v @ self.shift - intercept)
        x = np.diag(self.x)
        return float(max(v @ self.p @ v + 2 * offset * (v @ x) + self.rows * offset ** 2, 0.0))

    def r2(self, w: np.ndarray, intercept: float) -> float | None:
        total = self.rows * self.cov()[-1, -1]
        return float(1 - self.squared_error(w, intercept) / total) if total > 0 else None


def total(parts: Sequence[Sums]) -> Sums:
    out = parts[0]
    for s in parts[1:]:
        out = Sums(out.shift, out.n + s.n, out.x + s.x, out.q + s.q, out.p + s.p)
    return out


def sums(df: DataFrame, cols: Sequence[str], by: Column | None = None, complete: bool = True) -> dict[int | None, Sums]:
    """`Sums` of ``cols`` for each value of the whole number ``by`` (one group, None, without it).

    With ``complete`` only rows with all columns present count, else every pair has its own
    rows.  A null group is a group (None).  A table without rows has no groups.
    """
    cols, d = list(cols), len(cols)
    blocks = [(a, min(a + BLOCK, d)) for a in range(0, d, BLOCK)]
    plain = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)],
                      (F.lit(None) if by is None else by).cast("bigint").alias("g"))
    start = plain.limit(100).toPandas()[[f"c{i}" for i in range(d)]].astype(float).mean().to_numpy()
    shift = np.where(np.isfinite(start), start, 0.0)

    def products(v: np.ndarray, have: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        for i, (a0, a1) in enumerate(blocks):
            va, ha = v[:, a0:a1], have[:, a0:a1]
            for j, (b0, b1) in enumerate(blocks[i:], i):
                vb, hb = v[:, b0:b1], have[:, b0:b1]
                yield i, j, np.stack([ha.T @ hb, va.T @ hb, (va * va).T @ hb, va.T @ vb,
                                      ha.T @ vb, ha.T @ (vb * vb)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)]) - shift
            have = ~np.isnan(v)
            if complete:
                have &= have.all(axis=1)[:, None]
            v, have = np.where(have, v, 0.0), have.astype(float)
            group = batch.column(d).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            for g in np.unique(group).tolist():
                at = slice(None) if (group == g).all() else group == g
                for i, j, s in products(v[at], have[at]):
                    held[g, i, j] = held[g, i, j] + s if (g, i, j) in held else s
        yield from _rows(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for g, i, j, s in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                s = s.values.to_numpy()
                held[g, i, j] = held[g, i, j] + s if (g, i, j) in held else s.copy()
        yield from _rows(held)

    # as many rows as groups and block pairs come to the driver
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    added = plain.mapInArrow(add, _PART).repartition(parts, "g", "a", "b").mapInArrow(merge, _PART).collect()
    out: dict[int | None, Sums] = {}
    for r in added:
        g = None if r.g == -(1 << 62) else r.g
        if g not in out:
            out[g] = Sums(shift, *(np.zeros((d, d)) for _ in range(4)))
        (a0, a1), (b0, b1), own = blocks[r.a], blocks[r.b], out[g]
        n, x, q, p, xt, qt = np.array(r.s).reshape(6, a1 - a0, b1 - b0)
        for m, upper, lower in ((own.n, n, n.T), (own.x, x, xt.T), (own.q, q, qt.T), (own.p, p, p.T)):
            m[b0:b1, a0:a1] = lower
            m[a0:a1, b0:b1] = upper
    return out


def _rows(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (g, i, j), s in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([i], pa.int32()), pa.array([j], pa.int32()),
                                          pa.array([s.reshape(-1)], pa.list_(pa.float64()))], names=["g", "a", "b", "s"])


# ---------------------------------------------------------------- linear models

def cross_validate(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", penalty: float = 0.0
                   ) -> tuple[dict[int, tuple[np.ndarray, float]], dict[int, Sums]]:
    """M7 (coefficients, intercept) of each fold's model, fitted to the rows outside it, and that
    training set's sums: one pass over the data."""
    groups = sums(df, [*features, label], F.col(f"`{fold}`"))
    every = total(list(groups.values())) if groups else None
    train = {f: every - groups[f] for f in sorted(k for k in groups if k is not None)}
    return {f: s.solve(penalty / max(s.rows, 1)) for f, s in train.items()}, train


def predict_folds(df: DataFrame, features: Sequence[str], models: dict[int, tuple[np.ndarray, float]], fold: str = "fold",
                  out: str = "predicted") -> DataFrame:
    """Each row with the prediction of its fold's model (NULL where a feature is missing or no model is)."""
    value = F.lit(None).cast("double")
    for f, (w, b) in models.items():
        line = F.lit(b)
        for c, x in zip(features, w.tolist()):
            line = line + F.lit(x) * F.col(f"`{c}`")
        value = F.when(F.col(f"`{fold}`") == f, line).otherwise(value)
    return df.withColumn(out, value)


def grid_search(df: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float], fold: str = "fold"
                ) -> tuple[list[tuple[float, float]], tuple[np.ndarray, float]]:
    """M8 mean RMSE over the folds for each ridge penalty, and the best one's model refitted to
    all rows (lowest RMSE, the first of equals): one pass over the data.

    Features are standardised on each training fold (sample deviation); a penalty is in
    units of the label's deviation, as in an elastic net on a standardised label.
    """
    groups = sums(df, [*features, label], F.col(f"`{fold}`"))
    if not groups:
        return [], (np.zeros(len(features)), 0.0)
    every = total(list(groups.values()))

    def model(s: Sums, penalty: float) -> tuple[np.ndarray, float]:
        var = np.diag(s.cov())
        deviation = np.sqrt(np.maximum(var[:-1], 0) * s.rows / max(s.rows - 1, 1))
        return s.solve(penalty / np.sqrt(var[-1]) if var[-1] > 0 else 0.0, deviation)

    folds = sorted(k for k in groups if k is not None)
    scores = []
    for p in penalties:
        errors = [np.sqrt(groups[f].squared_error(*model(every - groups[f], p)) / groups[f].rows)
                  for f in folds if groups[f].rows and every.rows > groups[f].rows]
        scores.append((p, float(np.mean(errors)) if errors else float("nan")))
    best = min(scores, key=lambda s: (np.isnan(s[1]), s[1]))[0]
    return scores, model(every, best)
