"""Streams of envelopes and findings: an addition to the batch operators, with the same transformations.

Late and repeated deliveries are bounded by a watermark; state lives in the checkpoint folder that the caller names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rubricloom.operators.rejects import parse_lines


def read(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(stream: DataFrame, key: list[str], at: str, late: str = "14 days") -> DataFrame:
    """The first delivery of each key; rows later than ``late`` behind the newest are dropped with their state."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def hourly(stream: DataFrame, at: str, late: str = "14 days") -> DataFrame:
    """Findings by hour of receipt and severity, in event time."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("hour"), "severity").agg(F.count(F.lit(1)).alias("n"))


def rejects(stream: DataFrame) -> DataFrame:
    """Delivered lines parsed as they come; the parser is a narrow map, so it is the batch operator itself."""
    return parse_lines(stream)


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply any batch transformation to each micro-batch and append the result; a batch replayed after a failure
    overwrites its own folder, so nothing is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
