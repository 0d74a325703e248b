"""Incremental maintenance as a stream: new document files become changes, hashes and counts as they arrive.

An extension over batch maintenance: the same operators, fed by a file source. State that a stream keeps is bounded by its
watermark; everything else is written by micro-batch, each under its own number, so a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import text as T


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def first_seen(rows: DataFrame, time: str, within: str = "1 day") -> DataFrame:
    """Each content once within the watermark, by its hash."""
    hashed = rows.withColumn("hash", T.content_hash(F.col("text")))
    return hashed.withWatermark(time, within).dropDuplicatesWithinWatermark(["hash"])


def activity(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and kind, for events at most so late."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), kind).agg(F.count(F.lit(1)).alias("n"))


def append_batches(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes every micro-batch below folder/batch=<number>; a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
