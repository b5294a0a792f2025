"""Plan-shape checks: spatial joins are equi-joins on a cell key, no Python
UDF anywhere, filters reach the Parquet scan."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as ent


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SPATIAL = ["facility_counts", "clip_points", "zonal_lights", "zonal_indices", "road_density", "raster_extent"]


@pytest.mark.parametrize("name", SPATIAL)
def test_spatial_joins_are_equi_joins(spark, name):
    p = _plan(ent.queries()[name](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "HashJoin" in p or "SortMergeJoin" in p


@pytest.mark.parametrize("name", sorted(ent.oracle_sql()))
def test_no_python_udf(spark, name):
    p = _plan(ent.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_filters_pushed_to_scan(spark):
    from regionlens.operators import raster
    from regionlens.sources import fixtures as fx
    s = raster.date_range(fx.table(spark, SF_SMALL, "events"), "2024-01-05", "2024-01-20")
    p = _plan(s)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p
    c = fx.table(spark, SF_SMALL, "customer").where("c_nationkey = 7")
    assert "EqualTo(c_nationkey,7)" in _plan(c)
