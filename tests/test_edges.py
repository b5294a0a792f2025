"""Edge rows from the reference's branches."""

import pytest
from pyspark.sql import functions as F

from regionlens.functions import geo
from regionlens.operators import clean, evaluate, raster, spatial

SQ = [[{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0},
       {"x": 0.0, "y": 0.0}]]
FAR = [[{"x": 100.0, "y": 100.0}, {"x": 110.0, "y": 100.0}, {"x": 110.0, "y": 110.0},
        {"x": 100.0, "y": 110.0}, {"x": 100.0, "y": 100.0}]]


@pytest.fixture
def zones(spark):
    return spark.createDataFrame([("a", SQ), ("b", FAR)], f"geoid string, rings {geo.POLYGON_TYPE}")


def test_empty_facility_table(spark):
    pts = spark.createDataFrame([("p", 1.0, 1.0)], "id string, x double, y double")
    fac = spark.createDataFrame([], "facility_id long, x double, y double, amenity string")
    c = spatial.count_within(pts, fac, "id", (1000, 2000), ["school"]).first()
    assert c.school_count_1km == 0 and c.school_count_2km == 0
    n = spatial.nearest_facility(pts, fac, "id", ["school"]).first()
    assert n.nearest_school_dist is None


def test_zone_without_pixels_and_all_null_zone(spark, zones):
    px = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 7.0), (101.0, 101.0, None)],
                               "x double, y double, light double")
    st = {r.geoid: r for r in raster.zonal_stats(px, zones, "geoid", "light", 5.0).collect()}
    assert st["a"].viirs_mean == pytest.approx(6.0) and st["a"].viirs_std == pytest.approx(1.0)
    assert st["b"].viirs_mean is None and st["b"].viirs_count == 0
    only_a = px.where("x < 50")
    st2 = {r.geoid: r for r in raster.zonal_stats(only_a, zones, "geoid", "light", 5.0).collect()}
    assert set(st2) == {"a", "b"} and st2["b"].viirs_sum is None


def test_zero_area_density_is_null(spark):
    df = spark.createDataFrame([(100.0, 0.0), (100.0, 2e6)], "population double, area double")
    r = df.select(F.try_divide("population", F.col("area") / 1e6).alias("d")).collect()
    assert r[0].d is None and r[1].d == pytest.approx(50.0)


def test_missing_density_inputs(spark, zones):
    from regionlens.plans.features import build_feature_matrix
    fac = spark.createDataFrame([(1, 5.0, 5.0, "school")], "facility_id long, x double, y double, amenity string")
    segs = spark.createDataFrame([(1, 0, -1.0, 5.0, 11.0, 5.0)], "road_id long, seg int, ax double, ay double, bx double, by double")
    px = spark.createDataFrame([(1.0, 1.0, 5.0, 3.0, 2.0, 4.0)], "x double, y double, light double, nir double, red double, swir double")
    fm = {r.geoid: r for r in build_feature_matrix(zones, fac, segs, px, None, "geoid", 5.0, ["school"],
                                                   radii=(1000,), impute=False).collect()}
    assert fm["a"].population_density_per_sqkm is None
    assert fm["a"].total_road_length_m == pytest.approx(10.0)
    assert fm["b"].total_road_length_m == 0.0
    assert fm["a"].school_count_1km == 1


def test_no_category_column_returns_input(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    assert clean.category_filter(df, ["school"]).collect() == df.collect()


def test_nothing_to_impute(spark):
    df = spark.createDataFrame([(1.0, "a")], "v double, s string")
    assert clean.median_impute(df).collect() == df.collect()
    assert clean.median_impute(df, []).collect() == df.collect()


@pytest.mark.parametrize("initial,degraded,hib,want", [
    (1.0, 1.0, True, 0.0), (1.0, 0.5, True, float("inf")), (0.0, -0.1, True, 100.0), (0.0, 0.3, True, 0.0),
    (-0.5, -1.0, True, 100.0), (0.8, 0.6, True, 25.0), (0.0, 2.0, False, float("inf")), (0.0, 0.0, False, 0.0),
    (10.0, 12.0, False, 20.0), (None, 1.0, False, None)])
def test_degradation_branches(spark, initial, degraded, hib, want):
    df = spark.createDataFrame([(initial, degraded)], "i double, d double")
    got = df.select(evaluate.degradation(F.col("i"), F.col("d"), F.lit(hib)).alias("g")).first().g
    assert (got is None and want is None) or got == pytest.approx(want)


def test_empty_subgroup(spark):
    # every density equal: nobody is above the median, all rows are rural
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (3.0, 3.0, 5.0)], "actual double, predicted double, dens double")
    rows = evaluate.urban_rural(df, "dens").collect()
    assert [r.area_type for r in rows] == ["rural"] and rows[0].n == 2


def test_result_independent_of_shuffle_partitions(spark):
    from conftest import SF_SMALL
    from regionlens.sources import fixtures as fx
    old = spark.conf.get("spark.sql.shuffle.partitions")
    res = []
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            c = spatial.count_within(fx.centroids(spark, SF_SMALL), fx.facilities(spark, SF_SMALL), "geoid",
                                     (1000, 5000), fx.FACILITY_TYPES)
            res.append(sorted(map(tuple, c.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert res[0] == res[1]


def test_entry_works_without_the_add_on():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for module in ("regionlens.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; assert 'random_split' in e.queries()"
        done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
