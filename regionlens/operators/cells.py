"""Notebook-corpus cleaning (S15 corpus form of the cell cleaner:
F14-F16, A26, J10, U1, U4).

A corpus is one row per cell: ``notebook, idx, cell_type, source
(array<string>), outputs (array<struct<output_type, name, data>>)``.  All
flags are native predicates on the row, so cleaning a corpus of any size is
a single map-only pass; counts are one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords that mark a markdown cell as reasoning / failure.
REASONING_KEYWORDS = ["reasoning", "**reasoning**", "failed", "error", "issue",
                      "try again", "previous", "attempt"]


def cell_text(source: str = "source") -> Column:
    """Lower-cased source lines joined by a space."""
    return F.lower(F.array_join(F.col(source), " "))


def is_reasoning(keywords: Sequence[str] = REASONING_KEYWORDS) -> Column:
    """F14 markdown cell containing any keyword."""
    kw = F.array(*[F.lit(k) for k in keywords])
    return (F.col("cell_type") == "markdown") & F.exists(kw, lambda k: F.contains(cell_text(), k))


def has_error() -> Column:
    """F15 code cell with an error output or a stderr stream."""
    return (F.col("cell_type") == "code") & F.exists(
        F.col("outputs"), lambda o: F.coalesce((o.output_type == "error") | (o["name"] == "stderr"),
                                               F.lit(False)))


def has_viz() -> Column:
    """F15 code cell displaying an ``image/png``."""
    return (F.col("cell_type") == "code") & F.exists(
        F.col("outputs"), lambda o: F.coalesce((o.output_type == "display_data")
                                               & F.map_contains_key(o.data, "image/png"), F.lit(False)))


def flag_cells(cells: DataFrame, keywords: Sequence[str] = REASONING_KEYWORDS) -> DataFrame:
    return (cells.withColumn("is_reasoning", is_reasoning(keywords))
            .withColumn("has_error", has_error())
            .withColumn("has_viz", has_viz()))


def clean_cells(cells: DataFrame, keywords: Sequence[str] = REASONING_KEYWORDS) -> DataFrame:
    """F16 keep rule: drop cells in the skip set (reasoning U1 errors) unless
    they are visualisations.  The skip set is a flag on the row, so the
    anti-join / set difference (J10, U4) is a filter."""
    f = flag_cells(cells, keywords)
    keep = ~(F.col("is_reasoning") | F.col("has_error")) | F.col("has_viz")
    return f.where(keep).drop("is_reasoning", "has_error", "has_viz")


def skip_set(cells: DataFrame, keys: Sequence[str] = ("notebook", "idx"),
             keywords: Sequence[str] = REASONING_KEYWORDS) -> DataFrame:
    """U1 distinct union of the reasoning and error index lists."""
    f = flag_cells(cells, keywords)
    r = f.where("is_reasoning").select(*keys)
    e = f.where("has_error").select(*keys)
    return r.union(e).distinct()


def clean_by_anti_join(cells: DataFrame, keys: Sequence[str] = ("notebook", "idx"),
                       keywords: Sequence[str] = REASONING_KEYWORDS) -> DataFrame:
    """J10 / U4 the same keep rule as an anti-join against the skip set,
    visualisation cells added back."""
    f = flag_cells(cells, keywords)
    skip = skip_set(cells, keys, keywords)
    kept = f.join(skip, list(keys), "left_anti")
    viz_back = f.where("has_viz").join(skip, list(keys), "left_semi")
    return kept.unionByName(viz_back).drop("is_reasoning", "has_error", "has_viz")


def cell_counts(cells: DataFrame, keywords: Sequence[str] = REASONING_KEYWORDS) -> DataFrame:
    """A26 per notebook: cells, code, markdown, reasoning, error, viz, kept,
    removed -- one grouped aggregate."""
    f = flag_cells(cells, keywords)
    keep = ~(F.col("is_reasoning") | F.col("has_error")) | F.col("has_viz")
    return f.groupBy("notebook").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col("cell_type") == "code").alias("n_code"),
        F.count_if(F.col("cell_type") == "markdown").alias("n_markdown"),
        F.count_if("is_reasoning").alias("n_reasoning"),
        F.count_if("has_error").alias("n_error"),
        F.count_if("has_viz").alias("n_viz"),
        F.count_if(keep).alias("n_kept"),
        F.count_if(~keep).alias("n_removed"))
