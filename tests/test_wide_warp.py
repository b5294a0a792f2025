"""The target of a warp is made in the tasks: its plan holds no list of columns."""

from regionlens.operators import raster


def test_target_columns_are_no_literal(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (0, 99, 3.0)], "row int, col int, value double")
    out = raster.bilinear_warp(g, 2.0, 1.0)
    assert "[0,1,2,3" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.row, r.col): r.value for r in out.collect()}
    assert len(rows) == 50 and rows[0, 0] == 1.0 and rows[0, 49] == 3.0 and rows[0, 20] is None
    assert out.schema["col"].dataType.simpleString() == "int"
