"""Second-order gradient-boosted regression trees (M5), grown level by level.

Squared error has gradient g = margin - label and hessian h = 1 per row.  A node's best
split maximises

    GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)

over the cut points of all features, and a leaf weighs -G / (H + lambda), times the learning
rate.  Rows whose bins are equal share every node and margin, so they are grouped once into
cells, with the number of rows and the sum of labels that each model learns from.  All passes
go over the cells: at most (bins + 1) ^ features of them, and never more than rows.  G and H of
every cut point come from one grouped aggregate per level: each cell adds (g, h) to the bin of
each feature in its node.  The driver receives that histogram, whose size is set by nodes,
features and bins and not by the rows, and returns the next level of the trees.

Several models grow at once: with folds, model k learns from the rows outside fold k, and
all models share every pass over the data.  A cross-validation of five folds thus takes as
many jobs as one fit.

Margins and labels are rounded to whole multiples of a power of two that is fixed for the fit,
so the sums of gradients are whole numbers: the trees depend neither on the partitioning nor on
recomputed tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.operators import quantile
from regionlens.session import materialize

#: Rounds whose trees are applied on the fly before the margins are written anew.
PENDING = 8
#: Cells that a task of a pass has at least, and the tasks up to which the driver adds their histograms up itself.
TASK_ROWS, DIRECT = 1 << 15, 16


class Tree:
    """Nodes as a heap from 1: feature (-1: a leaf), cut (bins below it go left), the side of missing values."""

    def __init__(self, depth: int):
        n = 2 << depth
        self.feature, self.cut = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.missing_left = np.zeros(n, bool)
        self.weight, self.gain = np.zeros(n), np.zeros(n)
        self.depth = depth

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row (of bins per feature, -1: missing) ends in."""
        node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[node]
            b = bins[rows, f]
            left = np.where(b < 0, self.missing_left[node], b < self.cut[node])
            node = np.where(f < 0, node, 2 * node + ~left)
        return node


@dataclass
class Boosted:
    """A fitted ensemble: cut points per feature, the base score and one tree per round."""

    features: list[str]
    cuts: dict[str, list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction."""
        return df.withColumn(out, _predicted([self])(bins_column(self.features, self.cuts), F.lit(0)))

    def importances(self, spark: SparkSession) -> DataFrame:
        """M10 share of each feature in the mean gain of its splits, sorted."""
        mean = []
        for i in range(len(self.features)):
            gains = np.concatenate([t.gain[t.feature == i] for t in self.trees] or [np.zeros(0)])
            mean.append(float(gains.mean()) if len(gains) else 0.0)
        total = sum(mean) or 1.0
        rows = [(f, m / total) for f, m in zip(self.features, mean)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Equally long lists as rows."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def cut_points(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """At most ``bins`` - 1 cut points per feature: its exact quantiles, rounded to six places, without repeats."""
    qs = [i / bins for i in range(1, bins)]
    got = quantile.global_quantiles(df, list(features), qs)
    return {f: sorted({round(got[f, q], 6) for q in qs if got.get((f, q)) is not None}) for f in features}


def bins_column(features: Sequence[str], cuts: dict[str, list[float]]) -> Column:
    """Array of the bin of each feature: the number of cut points not above the value, -1 where it is missing."""
    def bin_of(f: str) -> Column:
        x = F.col(f"`{f}`").cast("double")
        below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c <= x)) if cuts[f] else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), -1).otherwise(below).cast("int")

    return F.array(*[bin_of(f) for f in features])


def best_split(g: np.ndarray, h: np.ndarray, scale: float, lam: float, least: float
               ) -> tuple[float, int, int, bool, int, int] | None:
    """(gain, feature, cut, missing left, GL, HL) of the best split of one node, or None.

    ``g`` (in steps of 1 / ``scale``) and ``h`` are whole numbers with a row per feature and a
    column per bin, the last one for missing values.  A cut c sends bins below c to the left.
    Equal gains go to the first feature, then the smallest cut, then to missing values on the
    right.
    """
    gl, hl = np.cumsum(g[:, :-1], axis=1)[:, :-1], np.cumsum(h[:, :-1], axis=1)[:, :-1]
    if not gl.size:
        return None
    # the last axis: missing values on the right, on the left
    gl, hl = np.stack([gl, gl + g[:, -1:]], axis=2), np.stack([hl, hl + h[:, -1:]], axis=2)
    whole_g, whole_h = g[0].sum(), h[0].sum()
    left, right, all_g = gl / scale, (whole_g - gl) / scale, whole_g / scale
    hr = whole_h - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left * left / (hl + lam) + right * right / (hr + lam) - all_g * all_g / (whole_h + lam)
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
    at = int(np.argmax(gain))
    f, c, side = np.unravel_index(at, gain.shape)
    if not gain[f, c, side] > 1e-6:
        return None
    return float(gain[f, c, side]), int(f), int(c) + 1, bool(side), int(gl[f, c, side]), int(hl[f, c, side])


def fit(df: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 6, rate: float = 0.3,
        lam: float = 1.0, least: float = 1.0, bins: int = 64, fold: str | None = None, folds: int = 1
        ) -> tuple[list[Boosted], DataFrame]:
    """Fit one ensemble, or with ``fold`` one per fold 0 .. ``folds`` - 1 on the rows outside it.

    Returns the models and ``df``'s rows of a non-null label with a column ``prediction``: with
    folds that of the model which has not seen the row.  Rows with a null fold train every
    model and are predicted by none.  Missing feature values go to the side that gains
    more.  ``least`` is the smallest sum of hessians of a child.  The base score is the mean
    label of a model's rows, to six places; a table without rows predicts nothing.
    """
    features, n_models = list(features), folds if fold else 1
    y = F.col(f"`{label}`").cast("double")
    group = F.coalesce(F.col(f"`{fold}`").cast("int"), F.lit(-1)) if fold else F.lit(-1)
    rows = materialize(df.where(F.col(f"`{label}`").isNotNull()).select("*", y.alias("_y"), group.alias("_f")), "boost-rows")
    cuts = cut_points(rows, features, bins)
    shape = (len(features), max((len(c) for c in cuts.values()), default=0) + 2)  # the last bin: missing
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_y").alias("lo"), F.max("_y").alias("hi"),
                     *[F.avg(F.when(F.col("_f") != k, F.col("_y"))).alias(f"m{k}") for k in range(n_models)]).first()
    models = [Boosted(features, cuts, round(stats[f"m{k}"] or 0.0, 6)) for k in range(n_models)]
    scale = gradient_scale(stats["n"], stats["hi"] - stats["lo"]) if stats["n"] else 1.0
    binned = bins_column(features, cuts)
    if stats["n"]:
        step = F.floor((F.col("_y") - stats["lo"]) * scale + 0.5)
        own = [F.col("_f") != k for k in range(n_models)]
        grouped = rows.groupBy(binned.alias("_b")).agg(
            F.array(*[F.count_if(c) for c in own]).alias("_n"),
            F.array(*[F.coalesce(F.sum(F.when(c, step)), F.lit(0)) for c in own]).alias("_s"))
        margins = materialize(grouped.withColumn("_m", F.array(*[F.lit(m.base) for m in models])), "boost-margins")
        # few cells need few tasks, and the passes are many
        tasks = -(-margins.count() // TASK_ROWS)
        margins = margins.coalesce(tasks)
    pending: list[list[Tree]] = []
    for r in range(rounds if stats["n"] else 0):
        trees = _grow(margins, pending, shape, n_models, scale, stats["lo"], depth, rate, lam, least, tasks <= DIRECT)
        for model, tree in zip(models, trees):
            model.trees.append(tree)
        pending.append(trees)
        if len(pending) >= PENDING and r + 1 < rounds:
            margins, pending = materialize(margins.withColumn("_m", _applied(pending)("_b", "_m")), "boost-margins").coalesce(tasks), []
    whose = F.col("_f") if fold else F.lit(0)
    out = rows.withColumn("prediction", _predicted(models)(binned, whose)).select(*[f"`{c}`" for c in df.columns], "prediction")
    return models, materialize(out, "boost-predictions")


def gradient_scale(n: int, spread: float) -> float:
    """A power of two: ``n`` gradients of up to ``spread`` times it add up to less than 2^61."""
    return 2.0 ** (60 - math.ceil(math.log2(max(spread, 1e-9))) - math.ceil(math.log2(n + 1)))


def _margins(bins: np.ndarray, margins: np.ndarray, pending: list[list[Tree]]) -> np.ndarray:
    """Margins (a column per model) with the trees of the last rounds added."""
    out = margins.copy()
    for trees in pending:
        for k, tree in enumerate(trees):
            out[:, k] += tree.weight[tree.leaves(bins)]
    return out


def _applied(pending: list[list[Tree]]):
    @F.arrow_udf("array<double>")
    def apply(bins: pa.Array, margins: pa.Array) -> pa.Array:
        m = _margins(_matrix(bins), _matrix(margins), pending)
        ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(m.reshape(-1)))

    return apply


def _predicted(models: list[Boosted]):
    """The prediction of model ``whose`` for each row of bins; null if there is no such model."""
    @F.arrow_udf("double")
    def predict(bins: pa.Array, whose: pa.Array) -> pa.Array:
        b, k = _matrix(bins), np.asarray(whose)
        out = np.zeros(len(b))
        for i, model in enumerate(models):
            at = np.flatnonzero(k == i)
            out[at] = _margins(b[at], np.full((len(at), 1), model.base), [[t] for t in model.trees])[:, 0]
        return pa.array(out, mask=(k < 0) | (k >= len(models)))

    return predict


def _histogram(margins: DataFrame, pending: list[list[Tree]], trees: list[Tree], slots: dict[tuple[int, int], int],
               shape: tuple[int, int], scale: float, lo: float, direct: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of g and h for each active node, feature and bin: one pass, added up in the tasks first,
    then in a shuffle or, if there are few tasks (``direct``), in the driver."""
    size, high = len(slots) * shape[0] * shape[1], 1 << 24
    slot_of = np.full((len(trees), len(trees[0].feature)), -1, np.int64)
    for (k, node), slot in slots.items():
        slot_of[k, node] = slot

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, n, s, m = (_matrix(batch.column(c)) for c in ("_b", "_n", "_s", "_m"))
            cells = np.where(bins < 0, shape[1] - 1, bins) + np.arange(shape[0]) * shape[1]
            m = _margins(bins, m, pending)
            for k, tree in enumerate(trees):
                slot = np.where(n[:, k] == 0, -1, slot_of[k, tree.leaves(bins)])
                at = np.flatnonzero(slot >= 0)
                step = n[at, k] * np.floor((m[at, k] - lo) * scale + 0.5).astype(np.int64) - s[at, k]
                cell = (cells[at] + (slot[at] * (shape[0] * shape[1]))[:, None]).reshape(-1)
                # bincount adds doubles: in two parts, which stay exact
                for part, unit in ((step & (high - 1), 1), (step >> 24, high)):
                    g += np.bincount(cell, np.repeat(part, shape[0]), size).astype(np.int64) * unit
                h += np.bincount(cell, np.repeat(n[at, k], shape[0]), size).astype(np.int64)
        at = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g[at]), pa.array(h[at])], names=["cell", "g", "h"])

    got = margins.select("_b", "_n", "_s", "_m").mapInArrow(add, "cell bigint, g bigint, h bigint")
    if not direct:
        got = got.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    cell, part_g, part_h = (c.to_numpy() for c in got.toArrow().select(["cell", "g", "h"]).columns)
    g, h = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(g, cell, part_g)
    np.add.at(h, cell, part_h)
    return g.reshape(len(slots), *shape), h.reshape(len(slots), *shape)


def _grow(margins: DataFrame, pending: list[list[Tree]], shape: tuple[int, int], models: int, scale: float, lo: float, depth: int,
          rate: float, lam: float, least: float, direct: bool) -> list[Tree]:
    """One tree per model, a level at a time."""
    trees = [Tree(depth) for _ in range(models)]

    def weigh(g: int, h: int) -> float:
        return -rate * (g / scale) / (h + lam) if h + lam > 0 else 0.0

    active = [(k, 1) for k in range(models)]
    for level in range(depth):
        g, h = _histogram(margins, pending, trees, {a: i for i, a in enumerate(active)}, shape, scale, lo, direct)
        following = []
        for (k, node), node_g, node_h in zip(active, g, h):
            tree, whole_g, whole_h = trees[k], int(node_g[0].sum()), int(node_h[0].sum())
            tree.weight[node] = weigh(whole_g, whole_h)
            found = best_split(node_g, node_h, scale, lam, least)
            if found:
                tree.gain[node], tree.feature[node], tree.cut[node], tree.missing_left[node], gl, hl = found
                tree.weight[2 * node], tree.weight[2 * node + 1] = weigh(gl, hl), weigh(whole_g - gl, whole_h - hl)
                following += [(k, 2 * node), (k, 2 * node + 1)]
        active = following
        if not active:
            break
    return trees
