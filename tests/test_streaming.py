"""The streaming mean composite equals the batch aggregate."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_stream_mean_composite_matches_batch(spark):
    from regionlens.sources import fixtures as fx
    from regionlens.streaming.composite import mean_composite_stream, run_available
    base = tempfile.mkdtemp(prefix="rl-stream-")
    src, sink, ck = f"{base}/src", f"{base}/sink", f"{base}/ck"
    sc = fx.scenes(spark, SF_SMALL)
    sc.write.parquet(src)
    run_available(mean_composite_stream(spark, src), sink, ck)
    got = spark.read.parquet(sink)
    want = (sc.groupBy(F.window("ts", "1 day").start.alias("window_start"), "pixel")
            .agg(F.avg("value").alias("mean_value"), F.count("value").alias("n_obs")))
    # append mode emits windows the watermark has passed; the last day may
    # still be open, every emitted row must equal the batch value
    j = got.join(want, ["window_start", "pixel"])
    assert got.count() > 0 and j.count() == got.count()
    assert j.where(F.abs(got.mean_value - want.mean_value) > 1e-9).count() == 0
