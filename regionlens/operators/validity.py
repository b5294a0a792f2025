"""G9 polygon validity: crossings found by an edge-to-edge join on small cells.

Every polygon gets a grid of its own, about one cell per edge, and only edges that share a
cell of their polygon are compared.  Exploded edges are many more rows than Spark's estimate of
them, so no join is left to its choice of a broadcast: all merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions import geo
from regionlens.operators.spatial import cell_join


def _side(ax, ay, bx, by, px, py) -> Column:
    """Sign of the turn a -> b -> p."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _between(ax, ay, bx, by, px, py) -> Column:
    """Whether p, on the line of a and b, lies within their box."""
    return (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx)) & (py >= F.least(ay, by)) & (py <= F.greatest(ay, by))


def invalid_parts(df: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(``key``, shape, crossing, outside) for each polygon; it is valid if all three are false.

    shape: a ring that is open, has fewer than four vertices or no area.  crossing: two edges
    of one ring meet elsewhere than at the vertex where they follow each other, or edges of
    two rings cross or run along each other (rings may touch at a point).  outside: a hole
    of which no vertex is inside the shell.  NULL rings count as a bad shape.  Rows that
    share a key are one polygon.  Holes inside holes are not looked for.
    """
    ring = df.select(key, F.posexplode(rings).alias("ring", "r"))
    edges = ring.select(key, "ring", F.size("r").alias("size"), F.posexplode(geo.ring_edges("r")).alias("seg", "e")).select(
        key, "ring", "seg", (F.col("size") - 1).alias("of"), "e.ax", "e.ay", "e.bx", "e.by")
    edges = edges.where("ax <> bx OR ay <> by")
    grid = edges.groupBy(key).agg(F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by")).alias("y0"),
                                  F.greatest(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")),
                                             F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).alias("extent"),
                                  F.count(F.lit(1)).alias("edges"))
    width = F.col("extent") / F.ceil(F.sqrt("edges"))
    placed = edges.join(grid.hint("merge"), key).withColumn("w", width)

    def cells(lo: str, hi: str, start: str) -> Column:
        return F.explode(F.sequence(F.floor((F.least(lo, hi) - F.col(start)) / F.col("w")),
                                    F.floor((F.greatest(lo, hi) - F.col(start)) / F.col("w"))))

    placed = placed.withColumn("cx", cells("ax", "bx", "x0")).withColumn("cy", cells("ay", "by", "y0")).select(
        key, "cx", "cy", "ring", "seg", "of", "ax", "ay", "bx", "by")
    other = placed.select(key, "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("ring", "seg", "ax", "ay", "bx", "by")])
    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    c, d = (F.col("o_ax"), F.col("o_ay")), (F.col("o_bx"), F.col("o_by"))
    pairs = cell_join(placed, other, [key, "cx", "cy"], cond=lambda l, r: (
        (l["ring"] < r["o_ring"]) | ((l["ring"] == r["o_ring"]) & (l["seg"] < r["o_seg"]))))
    s1, s2, s3, s4 = _side(*a, *b, *c), _side(*a, *b, *d), _side(*c, *d, *a), _side(*c, *d, *b)
    proper = (s1 * s2 < 0) & (s3 * s4 < 0)
    touch = ((s1 == 0) & _between(*a, *b, *c)) | ((s2 == 0) & _between(*a, *b, *d)) | \
            ((s3 == 0) & _between(*c, *d, *a)) | ((s4 == 0) & _between(*c, *d, *b))
    # on one line: the shared stretch has a length
    along = (s1 == 0) & (s2 == 0) & (
        (F.least(F.greatest(a[0], b[0]), F.greatest(c[0], d[0])) > F.greatest(F.least(a[0], b[0]), F.least(c[0], d[0])))
        | (F.least(F.greatest(a[1], b[1]), F.greatest(c[1], d[1])) > F.greatest(F.least(a[1], b[1]), F.least(c[1], d[1]))))
    gap = F.col("o_seg") - F.col("seg")
    follow = (F.col("ring") == F.col("o_ring")) & ((gap == 1) | (gap == F.col("of") - 1))
    bad = F.when(F.col("ring") != F.col("o_ring"), proper | along).when(follow, along).otherwise(proper | touch)
    crossing = pairs.where(bad).groupBy(key).agg(F.lit(True).alias("crossing"))

    within = ring.where("ring > 0").select(key, "ring", F.explode("r").alias("p")).join(
        edges.where("ring = 0").select(key, "ax", "ay", "bx", "by").hint("merge"), key)
    hit = ((F.col("ay") > F.col("p.y")) != (F.col("by") > F.col("p.y"))) & (
        F.col("p.x") < F.col("ax") + F.try_divide((F.col("p.y") - F.col("ay")) * (F.col("bx") - F.col("ax")), F.col("by") - F.col("ay")))
    outside = (within.groupBy(key, "ring", "p").agg((F.count_if(hit) % 2 == 1).alias("i")).groupBy(key, "ring")
               .agg(F.max("i").alias("i")).where("NOT i").groupBy(key).agg(F.lit(True).alias("outside")))
    shape = df.groupBy(key).agg(F.max(~F.coalesce(geo.is_valid(rings), F.lit(False))).alias("shape"))
    no = F.lit(False)
    return (shape.join(crossing.hint("merge"), key, "left").join(outside.hint("merge"), key, "left")
            .select(key, "shape", F.coalesce("crossing", no).alias("crossing"), F.coalesce("outside", no).alias("outside")))
