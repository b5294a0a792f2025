"""A long raster on a UTM grid: its curved band fills the target's bounds in small part."""

import pytest
from pyspark.sql import functions as F

from regionlens.operators import raster


def test_covered_pixels_are_the_others_of_the_whole_target(spark):
    grid = spark.range(1200).select((F.col("id") % 600).alias("col"), F.expr("id div 600").alias("row"),
                                    F.when(F.col("id") % 7 > 0, (F.col("id") % 13).cast("double")).alias("value"))
    place = (grid, 18, 250.0, -78.0, 0.005, 55.0, 0.003)
    every = {(r.row, r.col): (r.value, r.weight) for r in raster.reproject(*place).collect()}
    out = raster.reproject(*place, covered=True)
    got = {(r.row, r.col): (r.value, r.weight) for r in out.collect()}
    assert 1000 < len(got) < len(every) / 4
    assert got == {k: v for k, v in every.items() if v[1] is not None}
    assert sum(w for _, w in got.values()) == pytest.approx(
        sum(1 for i in range(1200) if i % 7) * (0.005 * 111320 * 0.5736 * 0.003 * 111320) / 250.0 ** 2, rel=0.1)
