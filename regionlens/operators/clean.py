"""Cleaning, filters, keys and imputation.

Scalar function groups used here and across the package are Spark
built-ins: X1 strings (lower, concat, substring, cast, contains, rlike,
array_join), X2 math (abs, sqrt, floor, unit arithmetic), X3 guarded
division (try_divide), X5 NULL handling (coalesce, isnull, count = 0)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Candidate category fields, in the order they are tried.
CATEGORY_FIELDS = ["amenity", "fclass", "type", "category", "shop"]

# The four census variables read from the ACS table.
ACS_INCOME = "B19013_001E"
ACS_POPULATION = "B01003_001E"
ACS_POVERTY_UNIVERSE = "B17021_001E"
ACS_POVERTY_COUNT = "B17021_002E"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- filters

def filter_county(df: DataFrame, county: str, state: str | None = None,
                  county_col: str = "county", state_col: str = "state") -> DataFrame:
    """F1 / F2 equality (and conjunctive) filter; pushed to the Parquet scan."""
    cond = F.col(county_col) == county
    if state is not None:
        cond = cond & (F.col(state_col) == state)
    return df.where(cond)


def filter_counties(df: DataFrame, counties: Sequence[str], county_col: str = "county") -> DataFrame:
    """F3 multi-county membership (an ``In`` filter, pushed down)."""
    return df.where(F.col(county_col).isin(list(counties)))


def stack_counties(frames: Sequence[DataFrame]) -> DataFrame:
    """U3 stack per-county frames into one multi-county frame."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def filter_years(df: DataFrame, years: Sequence[int], year_col: str = "year") -> DataFrame:
    """F4 membership filter on years."""
    return df.where(F.col(year_col).isin(list(years)))


def category_filter(df: DataFrame, values: Sequence[str],
                    fields: Sequence[str] = CATEGORY_FIELDS) -> DataFrame:
    """F5 keep rows whose first existing category field is (case-insensitively)
    one of ``values``; when no such field exists the input is returned as is."""
    present = {c.lower(): c for c in df.columns}
    field = next((present[f] for f in fields if f in present), None)
    if field is None:
        return df
    wanted = [v.lower() for v in values]
    return df.where(F.lower(F.col(field).cast("string")).isin(wanted))


def tag_predicate(spec: Mapping[str, object], tags_col: str = "tags") -> Column:
    """F6 tag predicate: ``{key: True}`` = key present, ``{key: [v, ...]}`` =
    value in list; several keys are OR-ed."""
    conds = []
    for k, v in spec.items():
        if v is True:
            conds.append(F.map_contains_key(F.col(tags_col), k))
        else:
            vals = [v] if isinstance(v, str) else list(v)
            conds.append(F.coalesce(F.element_at(F.col(tags_col), F.lit(k)).isin(vals), F.lit(False)))
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def tag_filter(df: DataFrame, spec: Mapping[str, object], tags_col: str = "tags") -> DataFrame:
    return df.where(tag_predicate(spec, tags_col))


def select_columns(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = (),
                   rename: Mapping[str, str] | None = None) -> DataFrame:
    """P1 column subset / drop / rename (pruned down to the scan)."""
    out = df.select(*keep) if keep else df
    out = out.drop(*drop) if drop else out
    for a, b in (rename or {}).items():
        out = out.withColumnRenamed(a, b)
    return out


def join_truth(features: DataFrame, truth: DataFrame, key: str = "geoid") -> DataFrame:
    """J3 inner join features x ground truth on the key; J4 rows are aligned
    by this explicit key, never by position."""
    return features.join(truth, key, "inner")


def common_keys(a: DataFrame, b: DataFrame, key: str = "geoid") -> DataFrame:
    """U2 intersection of row keys (a distinct set operation)."""
    return a.select(key).intersect(b.select(key))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """F7 drop rows with any NULL in ``subset``."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


# ---------------------------------------------------------------- keys, casts

def build_geoid(state, county, tract, block_group) -> Column:
    """P3 GEOID = state(2) || county(3) || tract(6) || block group(1)."""
    def pad(c, n):
        c = _c(c)
        return F.lpad(c.cast("string"), n, "0")
    return F.concat(pad(state, 2), pad(county, 3), pad(tract, 6), pad(block_group, 1))


def with_tract(df: DataFrame, geoid: str = "geoid", tract: str = "tract") -> DataFrame:
    """P4 tract = GEOID[5:11], only when the column is missing."""
    if tract in df.columns:
        return df
    return df.withColumn(tract, F.substring(F.col(geoid).cast("string"), 6, 6))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """P2 numeric columns by type (plan-time only, no data touched)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def cast_numeric(c, strict: bool = True, to: str = "double") -> Column:
    """P8 strict cast (ANSI: raises on bad input) or lenient (bad -> NULL)."""
    return _c(c).cast(to) if strict else _c(c).try_cast(to)


def relabel(c, mapping: Mapping) -> Column:
    """P9 dictionary relabel as a literal map lookup (X16 map functions)."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*kv), _c(c))


def non_negative(c) -> Column:
    """X4 sentinel clean-up: negative census codes -> NULL."""
    return F.when(_c(c) >= 0, _c(c))


def ratio(num, den) -> Column:
    """X3 / X11 guarded division: zero denominator -> NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


# ---------------------------------------------------------------- ACS

def acs_ground_truth(acs: DataFrame) -> DataFrame:
    """S6 + P3 + X4 + X11: GEOID, median income, population, poverty rate.

    The three census measures come from one row each, so a single projection
    replaces the reference's three sub-frames and their GEOID joins.
    """
    return acs.select(
        build_geoid("state", "county", "tract", "block_group").alias("geoid"),
        non_negative(ACS_INCOME).cast("double").alias("median_income"),
        non_negative(ACS_POPULATION).cast("double").alias("population"),
        ratio(non_negative(ACS_POVERTY_COUNT), non_negative(ACS_POVERTY_UNIVERSE)).alias("poverty_rate"))


# ---------------------------------------------------------------- A14

def median_impute(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A14 fill NULLs of numeric columns with their exact median.

    One pass counts the NULLs per column; the exact medians of the columns
    that have NULLs come from ``quantile.global_quantiles`` (histogram
    refinement, no column gathered in one task).  The result (one number per column) is
    applied to every row as literals (J11, as Spark does for a scalar
    subquery) with ``coalesce``.  Columns without NULLs are left alone.
    """
    from regionlens.operators.quantile import global_quantiles

    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols]).first()
    todo = [c for c in cols if row[f"n_{c}"] > 0]
    if not todo:
        return df
    med = global_quantiles(df, todo, [0.5])
    stats = {c: med.get((c, 0.5)) for c in todo}
    return df.select(*[F.coalesce(F.col(c), F.lit(stats[c]).cast(df.schema[c].dataType)).alias(c)
                       if c in todo else F.col(c) for c in df.columns])
