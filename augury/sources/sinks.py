"""Appending to stored tables, and resuming from what they hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.operators.dedup import admit
from augury.operators.lineage import cut
from augury.sources.tables import exists

# Blocks per stored part; rows per chunk; least volume of a market whose trades are fetched.
BLOCKS_PER_PART = 100_000
ROWS_PER_CHUNK = 10_000
LEAST_VOLUME = 100


def append_new(
    batch: DataFrame, path: str, key: str, arrival: str = "_fetched_at", ties: Sequence[str] | None = None, rows_per_file: int | None = None
) -> None:
    """Appends the rows whose key the table does not have; the first copy wins and is never changed.

    ``rows_per_file`` splits files for readers that need small ones; by default Spark decides.
    """
    spark = batch.sparkSession
    stored = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], batch.schema)
    writer = admit(stored, batch, key, arrival, ties).write.mode("append")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def append_batch(batch: DataFrame, batch_id: int, path: str, key: str, arrival: str = "_fetched_at") -> None:
    """Appends the new rows of a numbered batch in a directory of its own.

    A batch that comes again replaces that directory, so rows with and without a key are stored once,
    however often it is run.
    """
    spark, folder = batch.sparkSession, f"{path}/batch={batch_id}"
    stored = spark.read.parquet(path).where(F.col("batch") != batch_id).drop("batch") if exists(spark, path) else spark.createDataFrame([], batch.schema)
    admit(stored, batch, key, arrival).write.mode("overwrite").parquet(folder)


def next_chunk(spark: SparkSession, path: str, rows: int = ROWS_PER_CHUNK) -> int:
    """The number of the first row of the chunk after the last stored one; 0 for a new table."""
    if not exists(spark, path):
        return 0
    top = spark.read.schema("chunk long").parquet(path).agg(F.max("chunk")).first()[0]
    return 0 if top is None else int(top) + rows


def append_chunks(batch: DataFrame, path: str, key: str, arrival: str = "_fetched_at", rows: int = ROWS_PER_CHUNK) -> None:
    """Appends new rows to a table in chunks of ``rows`` rows, named by the number of their first row.

    The last chunk is filled up and rewritten, the rest starts new ones; full chunks stay untouched.
    Rows are numbered within tasks and shifted by the tasks before, so none passes through one task.
    """
    spark = batch.sparkSession
    if exists(spark, path):
        stored = spark.read.parquet(path)
        last = next_chunk(spark, path, rows) - rows
        tail = stored.where(F.col("chunk") == last).drop("chunk") if last >= 0 else None
        fresh = admit(stored.drop("chunk"), batch, key, arrival)
    else:
        last, tail, fresh = 0, None, admit(spark.createDataFrame([], batch.schema), batch, key, arrival)
    merged = fresh if tail is None else tail.select(*batch.columns).withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1))).drop("__new")
    numbered = cut(merged.withColumn("__task", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, offsets = max(last, 0), {}
    for r in numbered.groupBy("__task").count().orderBy("__task").collect():  # a row per task
        offsets[r["__task"]] = before
        before += r["count"]
    if not offsets:
        return
    shift = F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("__task"))
    at = F.col("__n") + shift
    placed = numbered.withColumn("chunk", at - at % rows).drop("__task", "__n")
    placed.repartition("chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def write_blocks(blocks: DataFrame, path: str, size: int = BLOCKS_PER_PART) -> None:
    """Writes block times in one directory per ``size`` blocks, sorted by number within a file."""
    part = F.expr(f"block_number div {size}")
    rows = blocks.withColumn("part", part).repartition("part").sortWithinPartitions("part", "block_number")
    rows.write.mode("append").partitionBy("part").parquet(path)


def next_block(spark: SparkSession, path: str, first: int = 0) -> int:
    """The block to go on with: after the largest stored one, or ``first`` for a new table."""
    if not exists(spark, path):
        return first
    top = spark.read.schema("block_number long").parquet(path).agg(F.max("block_number")).first()[0]
    return first if top is None else top + 1


def tickers_to_fetch(markets: DataFrame, stored_trades: DataFrame, least_volume: int = LEAST_VOLUME) -> DataFrame:
    """Tickers with enough volume that have no stored trade at all."""
    wanted = markets.where(F.col("volume") >= least_volume).select("ticker").distinct()
    return wanted.join(stored_trades.select("ticker").distinct(), "ticker", "left_anti")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{address: {collateral_symbol, collateral_decimals}}`` as rows."""
    kind = "map<string, struct<collateral_symbol: string, collateral_decimals: int>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("fpmm_address", "v"))
    return rows.select("fpmm_address", "v.collateral_symbol", "v.collateral_decimals")
