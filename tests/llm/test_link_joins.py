"""The join that links fingerprints is not left to Spark's estimate, which does not see exploded rows."""

import numpy as np
import pytest

from regionlens.llm import simhash
from regionlens.llm.tables import stored

KEY = "spark.sql.autoBroadcastJoinThreshold"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def prints(spark):
    rng = np.random.default_rng(3)
    own = rng.integers(-2**63, 2**63 - 1, 400, np.int64)
    near = own[:40] ^ (np.int64(1) << rng.integers(0, 62, 40)) ^ (np.int64(1) << rng.integers(0, 62, 40))
    return stored(spark.createDataFrame([(int(x),) for x in {*own, *near}], "fp bigint"), "test-prints")


def test_links_are_merged(spark, prints):
    values = [r.fp for r in prints.collect()]
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert len(want) >= 30
    old = spark.conf.get(KEY)
    try:
        for threshold in ("10MB", "-1"):
            spark.conf.set(KEY, threshold)
            links = simhash.linked_pairs(prints)
            assert "BroadcastExchange" not in plan(links)
            assert {tuple(r) for r in links.collect()} == want
            assert "BroadcastHashJoin" not in plan(links)  # nor by what the shuffles measured
    finally:
        spark.conf.set(KEY, old)
