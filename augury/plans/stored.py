"""Queries over decoders, stores and resuming: each writes or encodes stored rows and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions.keys import fill_key, id_key, ticker_key
from augury.functions.numbers import human
from augury.operators.lineage import shared_folder
from augury.plans import venue_k, venue_p, views
from augury.plans.training import first_trades, price_unit
from augury.sources import decode, sinks
from augury.sources.tables import exists, table

# Rows per chunk and blocks per part of the queries below.
CHUNK = 100
BLOCKS = 1_000_000


def _word(c: str) -> Column:
    return F.lpad(F.hex(F.col(c).cast("bigint")), 64, "0")


def _padded(c: str) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.substring(id_key(c), 3, 64), 64, "0"))


def _fill_logs(spark: SparkSession, d: str) -> DataFrame:
    """Stored fills as raw logs: numbers that fit 64 bits take the places of the data words."""
    topics = F.array(F.lit(decode.topic_of(decode.FILL_EVENT)), _padded("order_hash"), _padded("maker"), _padded("taker"))
    data = F.concat(F.lit("0x"), *map(_word, ("block_number", "log_index", "maker_amount", "taker_amount", "fee")))
    return table(spark, d, "p_trades").select(
        "block_number", "transaction_hash", "log_index", F.lit(None).cast("string").alias("address"), topics.alias("topics"), data.alias("data")
    )


def fill_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Stored fills as raw event logs, decoded again; logs that lack a topic or a word are left to ``undecodable_logs``."""
    rows = decode.fills(_fill_logs(spark, d))
    return rows.select(fill_key("transaction_hash", "log_index").alias("msg_key"), "order_hash", "maker", "taker", "maker_amount", "taker_amount", "fee")


def undecodable_logs(spark: SparkSession, d: str) -> DataFrame:
    """How many of these logs can't be decoded, and how many there are."""
    logs = _fill_logs(spark, d)
    bad = decode.undecodable(logs).agg(F.count("*").alias("n_undecodable"))
    return bad.crossJoin(logs.agg(F.count("*").alias("n_logs")))  # one row each


def amm_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Stored trades of market makers as raw event logs, decoded again."""
    event = F.when(F.col("is_buy"), decode.topic_of(decode.BUY_EVENT)).otherwise(decode.topic_of(decode.SELL_EVENT))
    index = F.concat(F.lit("0x"), _word("outcome_index"))
    data = F.concat(F.lit("0x"), *map(_word, ("amount", "fee_amount", "log_index")))
    logs = table(spark, d, "p_legacy").where(F.col("is_buy").isNotNull()).select(
        "block_number", "transaction_hash", "log_index", id_key("fpmm_address").alias("address"),
        F.array(event, _padded("trader"), index).alias("topics"), data.alias("data"),
    )
    rows = decode.amm_trades(logs)
    return rows.select(
        fill_key("transaction_hash", "log_index").alias("msg_key"), "fpmm_address", "trader", "amount", "fee_amount", "outcome_index", "outcome_tokens", "is_buy"
    )


def chunked_store(spark: SparkSession, d: str) -> DataFrame:
    """Markets appended in two batches to a table in chunks: rows and different ids per chunk."""
    path = f"{shared_folder(spark)}/chunks_{uuid.uuid4().hex}"
    markets = table(spark, d, "p_markets").select("id", "question", "_fetched_at")
    early = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    for batch in (markets.where(early), markets):
        sinks.append_chunks(batch, path, "id", rows=CHUNK)
    stored = spark.read.parquet(path) if exists(spark, path) else markets.limit(0).withColumn("chunk", F.lit(0))
    return stored.groupBy(F.col("chunk").cast("long").alias("chunk")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids")
    )


def block_store(spark: SparkSession, d: str) -> DataFrame:
    """Block times stored in parts of a million blocks and read back, with the block to go on with."""
    path = f"{shared_folder(spark)}/blocks_{uuid.uuid4().hex}"
    sinks.write_blocks(venue_p.block_times(table(spark, d, "p_blocks")), path, BLOCKS)
    parts = spark.read.schema("block_number long, timestamp string, part long").parquet(path).groupBy(F.col("part").cast("long").alias("part")).agg(
        F.count("*").alias("n_blocks"), F.min("block_number").alias("first"), F.max("block_number").alias("last")
    )
    return parts.withColumn("next_block", F.lit(sinks.next_block(spark, path)))


def wanted_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Tickers with a volume of 100 or more that had no stored trade at the start of 2023-04."""
    early = table(spark, d, "k_trades").where(F.col("_fetched_at") < F.lit("2023-04-01").cast("timestamp_ntz"))
    stored = early.select(ticker_key("ticker").alias("ticker"))
    return sinks.tickers_to_fetch(views.k_markets(spark, d), stored)


def last_row_flag(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly volume with the flag of the last, perhaps unfinished quarter."""
    rows = venue_k.volume_over_time(views.k_contracts(spark, d)).where(F.col("quarter").isNotNull())
    top = rows.agg(F.max("quarter").alias("top"))
    return rows.crossJoin(F.broadcast(top)).select("quarter", "volume_usd", (F.col("quarter") == F.col("top")).alias("is_last"))  # one row beside each quarter


def trade_count_labels(spark: SparkSession, d: str) -> DataFrame:
    """Trades per ticker with their short form in thousands and millions."""
    rows = table(spark, d, "k_trades").groupBy(ticker_key("ticker").alias("ticker")).agg(F.count("*").alias("n"), F.sum("count").alias("contracts"))
    return rows.where(F.col("ticker").isNotNull()).select("ticker", human(F.col("n")).alias("trades"), human(F.col("contracts") * 1000).alias("thousandths"))


def price_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Trades without a price on a side, by whether one was recorded and whether a unit is known."""
    rows = price_unit(spark, d)(first_trades(spark, d))
    side = lambda c: F.struct(F.lit(c).alias("side"), F.col(f"{c}_price").isNotNull().alias("recorded"))
    rows = rows.select(F.explode(F.array(side("yes"), side("no"))).alias("s"), F.col("unit.power").isNotNull().alias("has_unit"))
    return rows.groupBy("s.side", "s.recorded", "has_unit").agg(F.count("*").alias("n"))


def json_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Closed markets by whether their prices and token ids are strict JSON lists, which alone resolve them."""
    rows = views.p_markets(spark, d).where("closed")
    kind = lambda c: F.when(F.col(c).isNull() | (F.btrim(c) == ""), "none").when(venue_p.json_list(c).isNotNull(), "list").otherwise("skipped")
    return rows.groupBy(kind("outcome_prices").alias("prices"), kind("clob_token_ids").alias("tokens")).agg(F.count("*").alias("n"))
