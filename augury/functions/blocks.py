"""Block times: linear interpolation between sampled blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks that are made from one row at once.
EXPLODED = 100_000


def interpolate(samples: DataFrame, block: str = "block_number", seconds: str = "seconds", slice_blocks: int = 10_000_000) -> DataFrame:
    """``(block_number, seconds)`` of every block from the first to the last sample, floor of the linear course.

    Samples are cut into slices of block numbers; the first sample of a slice also closes the slice
    before, so no window sees more than a slice.  Gaps are filled piece by piece, however wide they are.
    """
    rows = samples.select(
        F.col(block).alias("b"), F.col(seconds).alias("s")
    ).where(F.col("b").isNotNull() & F.col("s").isNotNull()).groupBy("b").agg(F.min("s").alias("s"))
    rows = rows.withColumn("k", F.expr(f"b div {slice_blocks}"))
    heads = rows.groupBy("k").agg(F.min(F.struct("b", "s")).alias("h")).select("k", "h.*")
    order = Window.orderBy("k")  # one row per slice
    closing = heads.withColumn("k", F.lag("k").over(order)).where(F.col("k").isNotNull())
    ends = rows.unionByName(closing)
    w = Window.partitionBy("k").orderBy("b")
    steps = ends.withColumn("nb", F.lead("b").over(w)).withColumn("ns", F.lead("s").over(w))
    starts = F.sequence(F.col("b"), F.col("nb") - 1, F.lit(EXPLODED))
    pieces = steps.where(F.col("nb").isNotNull()).select("b", "s", "nb", "ns", F.explode(starts).alias("from"))
    upto = F.least(F.col("from") + (EXPLODED - 1), F.col("nb") - 1)
    inner = pieces.select("b", "s", "nb", "ns", F.explode(F.sequence(F.col("from"), upto)).alias("block_number"))
    at = F.col("s") + F.call_function("div", (F.col("ns") - F.col("s")) * (F.col("block_number") - F.col("b")), F.col("nb") - F.col("b"))
    last = rows.agg(F.max(F.struct("b", "s")).alias("h")).where(F.col("h").isNotNull()).select(
        F.col("h.b").alias("block_number"), F.col("h.s").alias("seconds")
    )
    return inner.select("block_number", at.alias("seconds")).unionByName(last)


def iso_z(seconds: str) -> Column:
    """Unix seconds as ``yyyy-MM-ddTHH:mm:ssZ`` in UTC, whatever the session's zone."""
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(seconds).cast("decimal(18,6)"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
