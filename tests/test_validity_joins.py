"""Validity of many polygons leaves no join to Spark's estimate, which does not see exploded rows."""

from pyspark.sql import functions as F

from regionlens.functions import geo
from regionlens.operators import validity


def test_no_broadcast_by_estimate(spark):
    corner = [geo.point(F.col("id") * a % 40, F.col("id") * b % 40) for a, b in ((7, 13), (11, 5), (17, 29), (23, 3))]
    df = spark.range(2000).select("id", F.array(F.array(*corner, corner[0])).alias("rings"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    few = {r.id: tuple(r) for r in validity.invalid_parts(df.where("id < 200"), "id").collect()}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200000")
        out = validity.invalid_parts(df, "id")
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: tuple(r) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == 2000 and few == {k: v for k, v in got.items() if k < 200}
