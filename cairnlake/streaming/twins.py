"""Structured Streaming twins of event-driven operators; each has a batch operator with the same result.

Event time without zone is cast to a timestamp (the session is in UTC) because watermarks need one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.session import shared_dir


def stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files that match ``path``."""
    return spark.readStream.schema(like.schema).parquet(path)


def windowed_counts(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Events and the sum of values by window and type; rows later than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n", "total")


def access_state(events: DataFrame) -> DataFrame:
    """Per key: first and last access and their number, kept as the stream goes on."""
    return events.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_accessed"), F.count(F.lit(1)).alias("access_count"))


def first_by_key(events: DataFrame, key: str, late: str = "40 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained(df: DataFrame, mode: str, reduce: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Run a stream over all that is there and give its result as a table in the shared folder.

    Each batch is written under its number, so a batch that runs again after a failure replaces itself; in complete mode
    the last batch holds the result.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        last.append(number)

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if not last:
        return reduce(spark.createDataFrame([], df.schema))
    rows = spark.read.schema(df.schema).parquet(*([f"{root}/out/batch={last[-1]}"] if mode == "complete" else [f"{root}/out/batch={n}" for n in sorted(set(last))]))
    return reduce(rows)
