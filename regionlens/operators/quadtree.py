"""An adaptive quadtree of facilities as keyed tables.

Cells split until they hold at most ``leaf`` spots, so dense places get small cells and
empty ones none.  The tree is two tables: its cells (type, level, cell, number of spots,
summed weight, whether it is a leaf) and its spots with the leaf that holds them.  Searches
go down from the top: a (point, cell) pair whose box settles the question is closed, only
the others meet the cell's children, a level at a time.  So a count touches the rim of a disc
and a nearest search the surroundings of its answer, whatever lies within.  For counts the
points stand in blocks, the leaves of a tree of their own: a block goes down as one, and its
points are measured against the spots of a leaf at once, as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionlens.session import materialize

#: Levels counted in one pass, and the deepest level (a leaf there may hold more spots).
BATCH, DEEPEST = 6, 24
#: Relative slack of box tests against the rounding of cell borders; what they leave open is measured.
SLACK = 1e-9
#: Most places of a block and spots of a leaf in a count, and blocks' places and (block, leaf) pairs that a group holds.
BLOCK, GROUP_PLACES, GROUP_PAIRS = 512, 8192, 256


@dataclass
class Tree:
    """Cells of width ``size`` / 2^k from the corner (x0, y0); ``depth`` is the deepest level in use.
    The rows of both tables are counted as they are made, so joins need not measure them."""

    size: float
    x0: float
    y0: float
    depth: int
    cells: DataFrame
    spots: DataFrame
    n_cells: int
    n_spots: int
    name_bytes: int

    def box(self, k="k", cx="cx", cy="cy") -> tuple[Column, Column, Column, Column]:
        width = F.lit(self.size) / F.pow(F.lit(2.0), F.col(k))
        x, y = F.lit(self.x0) + F.col(cx) * width, F.lit(self.y0) + F.col(cy) * width
        return x, y, x + width, y + width

    def children(self, pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Each pair (columns ``keep``, t, k, cx, cy) with the cells below its own."""
        from regionlens.operators.spatial import cell_join

        below = self.cells.where("k > 0").select(
            "t", F.expr("k - 1").alias("k"), F.expr("shiftright(cx, 1)").alias("px_"), F.expr("shiftright(cy, 1)").alias("py_"),
            F.col("cx").alias("cx_"), F.col("cy").alias("cy_"), "n", "leaf")
        up = pairs.select(*keep, "t", "k", F.col("cx").alias("px_"), F.col("cy").alias("py_"))
        return cell_join(up, below, ["t", "k", "px_", "py_"], right_bytes=self.bytes_of(below, self.n_cells)).select(
            *keep, "t", F.expr("k + 1").alias("k"), F.col("cx_").alias("cx"), F.col("cy_").alias("cy"), "n", "leaf")

    def children_or_self(self, pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Each pair with the cells below its own, or, as a leaf has none, with that itself (perhaps twice)."""
        from regionlens.operators.spatial import cell_join

        below = self.cells.where("k > 0").select(
            "t", F.expr("k - 1").alias("k"), F.expr("shiftright(cx, 1)").alias("px_"), F.expr("shiftright(cy, 1)").alias("py_"),
            F.col("cx").alias("cx_"), F.col("cy").alias("cy_"), F.col("leaf").alias("leaf_"))
        up = pairs.select(*keep, "t", "k", F.col("cx").alias("px_"), F.col("cy").alias("py_"), "leaf")
        met = cell_join(up, below, ["t", "k", "px_", "py_"], "left", right_bytes=self.bytes_of(below, self.n_cells))
        return met.select(*keep, "t", F.when(F.col("cx_").isNull(), F.col("k")).otherwise(F.col("k") + 1).alias("k"),
                          F.coalesce("cx_", "px_").alias("cx"), F.coalesce("cy_", "py_").alias("cy"),
                          F.coalesce("leaf_", "leaf").alias("leaf"))

    def bytes_of(self, df: DataFrame, rows: int) -> int:
        """Size of so many rows of ``df``: numbers, and types of the longest name met."""
        from regionlens.operators.spatial import _flat_row_bytes

        return rows * (_flat_row_bytes(df.schema) + self.name_bytes)

    def with_spots(self, pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Each pair of a leaf with the spots in it: columns fx, fy, w, fid (a packed tree: arrays, no fid)."""
        from regionlens.operators.spatial import cell_join

        return cell_join(pairs.select(*keep, "t", "k", "cx", "cy"), self.spots, ["t", "k", "cx", "cy"],
                         right_bytes=self.bytes_of(self.spots, self.n_spots))

    def packed(self) -> Tree:
        """The tree with the spots of each leaf in one row."""
        spot = F.collect_list(F.struct("fx", "fy", F.col("w").cast("double").alias("w"))).alias("s")
        rows = self.spots.groupBy("t", "k", "cx", "cy").agg(spot)
        return replace(self, spots=materialize(rows.select("t", "k", "cx", "cy", "s.fx", "s.fy", "s.w"), "tree-packed"))


def build(spots: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0, leaf: int = 16) -> Tree:
    """The tree of ``spots`` (t, fx, fy, w, fid), one row per type and place, finite coordinates.

    Some levels at a time are counted in one pass; another pass follows only for places
    that are still too dense.
    """
    u, v = (F.col("fx") - x0) / F.lit(size), (F.col("fy") - y0) / F.lit(size)

    def cell(c: Column, k: Column) -> Column:
        # scaling by a power of two is exact, so a cell's children are within it
        return F.floor(c * F.pow(F.lit(2.0), k)).cast("bigint")

    parts, placed, rest, depth, n_cells, n_spots, name_bytes = [], [], spots, 0, 0, 0, 0
    for first in range(0, DEEPEST + 1, BATCH):
        last = min(first + BATCH - 1, DEEPEST)
        level = F.explode(F.sequence(F.lit(first), F.lit(last)))
        spread = (rest.withColumn("k", level).withColumn("cx", cell(u, F.col("k"))).withColumn("cy", cell(v, F.col("k"))))
        counts = materialize(spread.groupBy("t", "k", "cx", "cy").agg(
            F.count(F.lit(1)).alias("m"), F.sum("w").alias("n")), "tree-counts")
        parents = counts.where(F.col("m") > leaf).select(
            "t", F.expr("k + 1").alias("k"), F.col("cx").alias("ux"), F.col("cy").alias("uy"))
        inner = counts.where(F.col("k") > first).withColumns(
            {"ux": F.expr("shiftright(cx, 1)"), "uy": F.expr("shiftright(cy, 1)")}).join(
            parents, ["t", "k", "ux", "uy"], "left_semi").select(*counts.columns)
        kept = counts.where(F.col("k") == first).unionByName(inner)
        deepest = DEEPEST if last == DEEPEST else -1
        kept = kept.withColumn("leaf", (F.col("m") <= leaf) | (F.col("k") == deepest))
        parts.append(kept)
        placed.append(spread.join(kept.where("leaf").select("t", "k", "cx", "cy"), ["t", "k", "cx", "cy"]))
        open_ = kept.where(~F.col("leaf") & (F.col("k") == last))
        deep, dense, own_cells, own_spots, longest = kept.agg(
            F.max("k"), F.count_if(~F.col("leaf") & (F.col("k") == last)), F.count(F.lit(1)),
            F.sum(F.when(F.col("leaf"), F.col("m"))), F.max(F.octet_length("t"))).first()
        depth, n_cells, n_spots = max(depth, deep or 0), n_cells + own_cells, n_spots + (own_spots or 0)
        name_bytes = max(name_bytes, longest or 0)
        if not dense:
            break
        rest = spread.where(F.col("k") == last).join(open_.select("t", "k", "cx", "cy"), ["t", "k", "cx", "cy"], "left_semi") \
            .select(*spots.columns)
    columns = ["t", "k", "cx", "cy", "n", "leaf"]
    cells = materialize(reduce(DataFrame.unionByName, parts).select(*columns), "tree-cells")
    held = reduce(DataFrame.unionByName, placed).select("t", "k", "cx", "cy", "fx", "fy", "w", "fid")
    return Tree(size, x0, y0, depth, cells, materialize(held, "tree-spots"), n_cells, n_spots, name_bytes)


def _box_distances(box: tuple, own: tuple) -> tuple[Column, Column]:
    """Squared distances between the nearest and between the farthest places of two boxes; a point is a box too."""
    x0, y0, x1, y1 = box
    lx, ly, hx, hy = (F.col(c) for c in own)
    zero = F.lit(0.0)
    near = F.greatest(x0 - hx, zero, lx - x1) ** 2 + F.greatest(y0 - hy, zero, ly - y1) ** 2
    far = F.greatest(hx - x0, x1 - lx) ** 2 + F.greatest(hy - y0, y1 - ly) ** 2
    return near, far


def count_in_discs(places: DataFrame, tree: Tree, radii: Sequence[float]) -> DataFrame:
    """px, py, t and c0, c1, ... (summed weight within each radius) of each place and type near it.

    ``places`` has px, py, finite and one row each; the tree's top cells are as wide as the largest radius.
    A cell wholly within the discs of all places of a block gives its count; one on a rim is opened.
    Blocks and the leaves on their rims meet in groups of bounded size, where they are measured.
    """
    from regionlens.operators.spatial import cell_join

    tree = tree.packed()
    held = build(places.select(F.lit("").alias("t"), F.col("px").alias("fx"), F.col("py").alias("fy"),
                               F.lit(1).cast("long").alias("w"), F.lit(None).cast("bigint").alias("fid")),
                 tree.size, tree.x0, tree.y0, BLOCK).spots
    held = held.select(F.concat_ws(",", "k", "cx", "cy").alias("b"), F.col("fx").alias("px"), F.col("fy").alias("py"))
    blocks = materialize(held.groupBy("b").agg(F.min("px").alias("lx"), F.min("py").alias("ly"), F.max("px").alias("hx"),
                                               F.max("py").alias("hy"), F.count(F.lit(1)).alias("m")), "blocks")
    box = ("lx", "ly", "hx", "hy")
    own = ["b", *box, "open"]
    counts = [f"c{i}" for i in range(len(radii))]
    block = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    top = (tree.cells.where("k = 0").withColumn("o", F.explode(block))
           .withColumns({"ax": F.col("cx") + F.col("o.dx"), "ay": F.col("cy") + F.col("o.dy")}).drop("o"))
    start = blocks.withColumns({"ax": F.floor((F.col("lx") - tree.x0) / tree.size).cast("bigint"),
                                "ay": F.floor((F.col("ly") - tree.y0) / tree.size).cast("bigint"),
                                "open": F.lit((1 << len(radii)) - 1)})
    pairs = cell_join(start, top, ["ax", "ay"], right_bytes=tree.bytes_of(top, 9 * tree.n_cells)).select(*own, "t", "k", "cx", "cy", "n", "leaf")
    whole, leaves = [], []
    for level in range(tree.depth + 1):
        near, far = _box_distances(tree.box(), box)
        inside = [(F.col("open").bitwiseAND(1 << i) != 0) & (far <= r * r * (1 - SLACK)) for i, r in enumerate(radii)]
        rim = [(F.col("open").bitwiseAND(1 << i) != 0) & (far > r * r * (1 - SLACK)) & (near <= r * r * (1 + SLACK))
               for i, r in enumerate(radii)]
        still = reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(rim)])
        seen = materialize(pairs.select("b", *box, "t", "k", "cx", "cy", "leaf", still.alias("open"), *[
            F.when(c, F.col("n")).otherwise(0).alias(f"c{i}") for i, c in enumerate(inside)]), "disc-pairs")
        whole.append(seen.select("b", "t", *counts).where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in counts])))
        leaves.append(seen.where((F.col("open") > 0) & F.col("leaf")).select(*own, "t", "k", "cx", "cy"))
        if level < tree.depth:
            pairs = tree.children(seen.where((F.col("open") > 0) & ~F.col("leaf")), own)
    leaves = reduce(DataFrame.unionByName, leaves)
    groups = max(1, math.ceil((blocks.agg(F.sum("m")).first()[0] or 0) / GROUP_PLACES), math.ceil(leaves.count() / GROUP_PAIRS))
    met = tree.with_spots(leaves, ["b", "open"]).select("b", "t", "open", "fx", "fy", "w", *[F.lit(0).cast("bigint").alias(c) for c in counts])
    none = F.array().cast("array<double>")
    settled = reduce(DataFrame.unionByName, whole).groupBy("b", "t").agg(*[F.sum(c).alias(c) for c in counts]).select(
        "b", "t", F.lit(0).alias("open"), *[none.alias(c) for c in ("fx", "fy", "w")], *counts)
    group = F.pmod(F.xxhash64("b"), F.lit(groups)).alias("g")
    squares = [float(r) ** 2 for r in radii]

    def measure(points: pd.DataFrame, facing: pd.DataFrame) -> pd.DataFrame:
        return _measured(points, facing, squares)

    return (held.groupBy(group).cogroup(met.unionByName(settled).groupBy(group))
            .applyInPandas(measure, "px double, py double, t string, " + ", ".join(f"{c} bigint" for c in counts)))


def _measured(points: pd.DataFrame, facing: pd.DataFrame, squares: Sequence[float]) -> pd.DataFrame:
    """Counts of each of the ``points`` (block b, px, py) by type: what is settled for its block, and the
    spots (arrays) at most the root of ``squares`` away, for the radii that are open."""
    rows = points.groupby("b").indices
    px, py = points["px"].to_numpy(), points["py"].to_numpy()
    sums: dict[tuple, np.ndarray] = {}
    for r in facing.itertuples(index=False):
        own = rows[r.b]
        total = sums.setdefault((r.b, r.t), np.zeros((len(squares), len(own)), np.int64))
        total += np.array([getattr(r, f"c{i}") for i in range(len(squares))], np.int64)[:, None]
        for a in range(0, len(r.fx) if r.open else 0, 8 * BLOCK):
            fx, fy, w = (np.asarray(c[a:a + 8 * BLOCK]) for c in (r.fx, r.fy, r.w))
            with np.errstate(over="ignore"):
                d2 = (px[own][:, None] - fx) ** 2 + (py[own][:, None] - fy) ** 2
            for i, square in enumerate(squares):
                if r.open >> i & 1:
                    total[i] += ((d2 <= square) @ w).astype(np.int64)
    at = np.concatenate([rows[b] for b, _ in sums]) if sums else np.zeros(0, np.int64)
    all_sums = np.concatenate(list(sums.values()), axis=1) if sums else np.zeros((len(squares), 0), np.int64)
    kinds = [t for (b, t) in sums for _ in range(len(rows[b]))]
    return pd.DataFrame({"px": px[at], "py": py[at], "t": pd.Series(kinds, dtype=object)} | {f"c{i}": c for i, c in enumerate(all_sums)})


def nearest_spots(points: DataFrame, tree: Tree, key: str, types: Sequence[str]) -> DataFrame:
    """``key``, px, py, t, d2 and fid of the nearest spot of each type, the smallest fid of equals.

    Every point starts at the top cells.  At each level the pairs are replaced by the cells
    below, leaves stay; the nearest of their farthest places bounds the answer, and cells
    that begin beyond it are dropped.
    """
    who = Window.partitionBy(key, "px", "py", "t")
    start = points.withColumn("t", F.explode(F.array(*[F.lit(t) for t in types])))
    tops = F.broadcast(tree.cells.where("k = 0"))   # one cell per type
    pairs = start.join(tops, "t").select(key, "px", "py", "t", "k", "cx", "cy", "leaf")
    for level in range(tree.depth + 1):
        if level:
            pairs = tree.children_or_self(pairs, [key, "px", "py"])
        near, far = _box_distances(tree.box(), ("px", "py", "px", "py"))
        pairs = pairs.withColumn("bound", F.min(far).over(who)).where(near <= F.col("bound") * (1 + SLACK)).drop("bound")
        if level % 4 == 3 and level < tree.depth:
            pairs = materialize(pairs, "nearest-pairs")
    met = tree.with_spots(pairs, [key, "px", "py"])
    d2 = (F.col("px") - F.col("fx")) ** 2 + (F.col("py") - F.col("fy")) ** 2
    best = met.groupBy(key, "px", "py", "t").agg(F.min(F.struct(d2.alias("d2"), "fid")).alias("b"))
    return best.select(key, "px", "py", "t", "b.d2", "b.fid")
