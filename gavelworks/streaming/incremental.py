"""Incremental ingestion: a landing folder is read once, as a stream that stops when it has caught up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, landing: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, state: str) -> None:
    """Transform what is new in `landing` (parquet) and append it to `out`; `state` remembers what was read, so a rerun adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream = spark.readStream.schema(schema).parquet(landing)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per hour and type of a stream (ts, event_type, value), complete once the watermark has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
