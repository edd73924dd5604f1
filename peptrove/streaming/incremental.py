"""Incremental forms of the batch operators with Structured Streaming (2.K, extensions).

The corpus is loaded in batches; these give the same results while files arrive.
State is bounded: by a watermark where rows are remembered, by keys where they
are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import sums


def arriving(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a landing folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def first_seen(stream: DataFrame, keys: list[str], at: str, lateness: str = "1 day") -> DataFrame:
    """Each key once while it can still be late."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, width: str, keys: list[str], lateness: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts a window and key; a window is final when the watermark has passed it."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, lateness).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))


def partial_sums(batch: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    """Additive statistics of one batch, to be appended and combined at read."""
    return sums(keys, batch, *cols)


def load(stream: DataFrame, path: str, checkpoint: str, key: str | None = None) -> None:
    """Writes everything that has arrived and ends (availableNow). With ``key`` the partitions that a
    batch touches are replaced, so that loading the same files again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if key:
            batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
        else:
            batch.write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
