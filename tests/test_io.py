"""Sources and sinks on small files written by the test itself."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from regionlens.functions import geo
from regionlens.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="rl-io-")


def test_feature_collection_parts_and_types(spark):
    d = _tmp()
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"GEOID": "510010001001", "STATEFP": "51", "COUNTYFP": "001"},
         "geometry": {"type": "MultiPolygon", "coordinates": [
             [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]],
             [[[10, 10], [13, 10], [13, 13], [10, 13], [10, 10]], [[11, 11], [12, 11], [12, 12], [11, 12], [11, 11]]]]}},
        {"type": "Feature", "properties": {"GEOID": "510020001001", "STATEFP": "51", "COUNTYFP": "002"},
         "geometry": {"type": "Polygon", "coordinates": [[[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 0.5]]]}},
        {"type": "Feature", "properties": {"GEOID": "x", "STATEFP": "37", "COUNTYFP": "001"},
         "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}},
        {"type": "Feature", "properties": {"GEOID": "p", "STATEFP": "37", "COUNTYFP": "009"},
         "geometry": {"type": "Point", "coordinates": [7, 8]}},
    ]}
    with open(os.path.join(d, "a.geojson"), "w") as f:
        json.dump(fc, f, indent=2)
    df = io.read_geojson(spark, d, "GEOID string, STATEFP string, COUNTYFP string")
    rows = {(r.GEOID, r.part): r for r in df.withColumn("area", geo.polygon_area("rings")).collect()}
    assert rows[("510010001001", 0)].area == pytest.approx(4.0)
    assert rows[("510010001001", 1)].area == pytest.approx(9.0 - 1.0)
    assert rows[("510020001001", 0)].gtype == "Polygon"
    line = rows[("x", 0)]
    assert line.gtype == "LineString"
    assert spark.createDataFrame([(line.rings[0],)], f"l {geo.LINE_TYPE}").select(
        geo.line_length("l").alias("n")).first().n == pytest.approx(5.0)
    assert rows[("p", 0)].rings[0][0].x == 7.0
    b = io.read_boundaries(spark, d, state="51", counties=["002"])
    assert [r.GEOID for r in b.collect()] == ["510020001001"]


def test_geojson_seq_roundtrip_keeps_ids_as_strings(spark):
    d = _tmp()
    df = spark.createDataFrame([("0012", [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0},
                                           {"x": 0.0, "y": 0.0}]])], f"geoid string, rings {geo.POLYGON_TYPE}")
    io.write_geojson(df, d, "rings", ["geoid"])
    back = io.read_geojson(spark, d, "geoid string", collection=False).first()
    assert back.geoid == "0012" and back.rings == df.first().rings


def test_notebook_files(spark):
    d = _tmp()
    nb = {"cells": [
        {"cell_type": "markdown", "source": ["# Reasoning\n", "we failed"], "metadata": {}},
        {"cell_type": "code", "source": ["plot()"], "metadata": {}, "outputs": [
            {"output_type": "display_data", "data": {"image/png": "AAA", "text/plain": "<Figure>"}}]},
        {"cell_type": "code", "source": ["1/0"], "metadata": {}, "outputs": [
            {"output_type": "error", "ename": "ZeroDivisionError"}]},
        {"cell_type": "code", "source": ["x = 1"], "metadata": {}, "outputs": []},
    ], "metadata": {}, "nbformat": 4, "nbformat_minor": 5}
    for i in range(2):
        with open(os.path.join(d, f"n{i}.ipynb"), "w") as f:
            json.dump(nb, f, indent=1)
    from regionlens.operators import cells as cl
    c = io.read_notebooks(spark, d)
    counts = cl.cell_counts(c).collect()
    assert len(counts) == 2
    r = counts[0]
    assert (r.n_cells, r.n_reasoning, r.n_error, r.n_viz, r.n_kept) == (4, 1, 1, 1, 2)


def test_csv_ids_stay_strings(spark):
    d = os.path.join(_tmp(), "acs")
    spark.createDataFrame([("51", "007", "000100", "1", 1.0, 2.0, 3.0, 1.0)], io.ACS_SCHEMA) \
        .write.option("header", True).csv(d)
    r = io.read_acs(spark, d).first()
    assert r.county == "007" and r.tract == "000100"


def test_raster_nodata_masked(spark):
    d = os.path.join(_tmp(), "px")
    spark.createDataFrame([(0, 0, 1.0), (0, 1, -9999.0), (1, 0, float("nan"))], "row int, col int, value double") \
        .write.parquet(d)
    vals = sorted((r.row, r.col, r.value) for r in io.read_raster(spark, d, nodata=-9999.0).collect())
    assert vals == [(0, 0, 1.0), (0, 1, None), (1, 0, None)]
