"""Incremental ingest and running aggregates with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from augury.sources.sinks import append_batch


def drop_repeats(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """One row per key among rows that arrive within ``delay``; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str, arrival: str = "_fetched_at") -> StreamingQuery:
    """Appends each batch's new rows to a table.

    A batch that runs again after a failure replaces what it wrote, so it adds nothing twice, rows without
    a key included.
    """
    return stream.writeStream.foreachBatch(
        lambda batch, number: append_batch(batch, number, path, key, arrival)
    ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_volume(stream: DataFrame, time: str, amount: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows and sums per tumbling window; rows later than ``delay`` are not counted."""
    at = stream.withWatermark(time, delay).groupBy(F.window(time, width))
    return at.agg(F.count("*").alias("n"), F.sum(amount).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def running_calibration(stream: DataFrame) -> DataFrame:
    """Positions and wins per price over everything seen so far (complete mode)."""
    return stream.groupBy("price").agg(F.count("*").alias("total"), F.sum("won").alias("wins"))


def run_to_memory(result: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is available and gives its table; for results of a few rows."""
    writer = result.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return result.sparkSession.table(name)
