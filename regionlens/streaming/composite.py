"""A20 under Structured Streaming: the temporal mean composite over scene
observations that keep arriving as Parquet files.

The reference has no streaming operator (no watermark, trigger or state);
this is the one aggregate that carries over unchanged.  Observations are
grouped per pixel and acquisition day with a watermark on the timestamp, so
state for a day is dropped once the watermark passes it and rows are
emitted in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCENE_SCHEMA = T.StructType([
    T.StructField("scene_id", T.LongType()), T.StructField("pixel", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("cloud_pct", T.LongType()),
    T.StructField("qa60", T.IntegerType()), T.StructField("value", T.DoubleType()),
])


def mean_composite_stream(spark: SparkSession, source: str, window: str = "1 day",
                          late: str = "1 day", schema: T.StructType = SCENE_SCHEMA) -> DataFrame:
    """Streaming per-pixel mean per time window (watermarked, append mode)."""
    s = spark.readStream.schema(schema).parquet(source)
    # watermarks need TIMESTAMP; scene times are TIMESTAMP_NTZ (session tz)
    s = s.withColumn("_ets", F.col("ts").cast("timestamp"))
    return (s.withWatermark("_ets", late)
            .groupBy(F.window("_ets", window).alias("w"), "pixel")
            .agg(F.avg("value").alias("mean_value"), F.count("value").alias("n_obs"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "pixel", "mean_value", "n_obs"))


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process everything available now into a Parquet sink, then stop."""
    q = (stream.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
