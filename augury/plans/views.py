"""The relations that the analyses read, over the stored tables.

Stored tables hold several spellings of a key, several fetches of a market and prices in several units.
``k_trades`` here gives every trade once, by the identifier of problem 5, with its prices in whole cents,
``p_fills`` every fill once with both amounts in millionths, and ``k_markets`` / ``p_markets`` the latest
fetch of each key.  The analyses take any relations with these columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augury.functions.keys import fill_key, id_key, ticker_key
from augury.operators.dedup import keep_first
from augury.operators.units import shift_text
from augury.plans.training import amount_unit, first_trades, price_unit, token_unit
from augury.sources.tables import table

#: Column with the number of trades that a row stands for.
ALIKE = "__alike"


def latest(df: DataFrame, key: str, by: str, ties: Sequence[str]) -> DataFrame:
    """The last row of each key by time; ties go to the smallest values of ``ties``."""
    order = [F.col(by).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ties)]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") == 1).drop("__n")


def k_contracts(spark: SparkSession, d: str) -> DataFrame:
    """All trades without their prices, each delivered once."""
    return first_trades(spark, d).select(ticker_key("ticker").alias("ticker"), "count", "taker_side", "created_time")


def in_cents(price: str) -> Column:
    """A price in whole cents by the row's ``unit``, halves up; null where the price or its unit is unknown."""
    return F.round(F.col(price) / F.pow(F.lit(10.0), 2 - F.col("unit.power")), 0).cast("int").alias(price)


def k_trades(spark: SparkSession, d: str) -> DataFrame:
    """All trades, each delivered once, each price in whole cents by the unit of problem 4 and rounded on its own.

    Prices are brought to cents ahead of the shuffle by identifier, so filters on them repeat no unit's rules.
    """
    rows = price_unit(spark, d)(table(spark, d, "k_trades").withColumn("msg_key", id_key("trade_id")))
    cents = rows.select("*", in_cents("yes_price").alias("__yes"), in_cents("no_price").alias("__no")).drop("told", "unit")
    return keep_first(cents, "msg_key", "_fetched_at").select(
        ticker_key("ticker").alias("ticker"), "count", F.col("__yes").alias("yes_price"), F.col("__no").alias("no_price"), "taker_side", "created_time"
    )


def k_markets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "k_markets").select(
        ticker_key("ticker").alias("ticker"), "status", "result", "event_ticker", "volume", "_fetched_at"
    ).where(F.col("ticker").isNotNull())
    return latest(rows, "ticker", "_fetched_at", ["status", "result", "event_ticker", "volume"])


def p_markets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "p_markets").select(
        "id",
        "outcomes",
        "outcome_prices",
        "clob_token_ids",
        id_key("market_maker_address").alias("market_maker_address"),
        "closed",
        "_fetched_at"
    )
    return latest(rows, "id", "_fetched_at", ["outcome_prices", "clob_token_ids", "market_maker_address"])


def p_legacy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "p_legacy").select(
        "block_number", id_key("fpmm_address").alias("fpmm_address"), "amount", "outcome_index", "outcome_tokens"
    )


def p_fills(spark: SparkSession, d: str) -> DataFrame:
    """Fills, each delivered once, with both amounts in millionths, the maker's by the unit of problem 4."""
    power = F.col("unit.power")
    scaled = F.when(power < 0, F.col("maker_amount") / F.pow(F.lit(10.0), -power)).otherwise(
        F.col("maker_amount") * F.pow(F.lit(10.0), power)
    )
    stored = table(spark, d, "p_trades").withColumn("msg_key", fill_key("transaction_hash", "log_index"))
    rows = amount_unit(spark, d, stored).withColumn("__amount", scaled).drop("told", "unit")
    return keep_first(rows, "msg_key", "_fetched_at").select(
        "block_number", "maker_asset_id", "taker_asset_id", F.col("__amount").alias("maker_amount"), "taker_amount"
    )


def p_amm(spark: SparkSession, d: str) -> DataFrame:
    """AMM trades with amount and outcome tokens in millionths, the tokens by the unit of problem 4; null if unreadable.

    The number comes out of a generator, which filters do not pass, so the text is read once.
    """
    tokens = shift_text(F.col("read.number"), F.col("read.power")).cast("double") / 1e12
    return token_unit(spark, d).select(
        "block_number", id_key("fpmm_address").alias("fpmm_address"), "amount", "outcome_index", F.explode(F.array(tokens)).alias("outcome_tokens")
    )


def resolved(markets: DataFrame, finalized: bool = True) -> DataFrame:
    """Markets with a result, finalised ones only unless told otherwise."""
    keep = F.col("result").isin("yes", "no")
    return markets.where(keep & (F.col("status") == "finalized") if finalized else keep)


def on(cond: Column, then: Column | int, other: Column | int = 0) -> Column:
    """``CASE WHEN cond THEN then ELSE other END``: an unknown condition takes the ELSE branch."""
    return F.when(cond, then).otherwise(other)


def compact(trades: DataFrame, *more: str) -> DataFrame:
    """Trades that differ in nothing an analysis by price looks at, as one row with their number in ``ALIKE``.

    Done before the join to markets: a hot ticker leaves each task as some hundred rows, so the join
    shuffles combinations of ticker and price, not trades.  ``count`` becomes the sum of contracts.
    """
    keys = ["ticker", "yes_price", "no_price", "taker_side", *more]
    return trades.groupBy(*keys).agg(F.count("*").alias(ALIKE), F.sum("count").alias("count"))


def sized(trades: DataFrame) -> DataFrame:
    """Like :func:`compact`, but trades of one size: ``count`` stays the contracts of each, ``ALIKE`` their number."""
    if ALIKE in trades.columns:
        return trades
    return trades.groupBy("ticker", "yes_price", "no_price", "taker_side", "count").agg(F.count("*").alias(ALIKE))


def traded(trades: DataFrame, markets: DataFrame, finalized: bool = True, *more: str) -> DataFrame:
    """Trades of resolved markets, from the taker's and the maker's side in one scan.

    A side is ``yes`` or it is taken as no; a null side wins for neither.  Each row of
    uncompacted trades stands for one.
    """
    trades = trades if ALIKE in trades.columns else trades.withColumn(ALIKE, F.lit(1))
    yes = F.col("taker_side") == "yes"
    rows = trades.join(resolved(markets, finalized).select("ticker", "result", *more), "ticker")
    return rows.select(
        "*",
        on(yes, F.col("yes_price"), F.col("no_price")).alias("taker_price"),
        on(yes, F.col("no_price"), F.col("yes_price")).alias("maker_price"),
        on(F.col("taker_side") == F.col("result"), 1).alias("taker_won"), on(F.col("taker_side") != F.col("result"), 1).alias("maker_won"),
    )


def positions(rows: DataFrame, *keep: str) -> DataFrame:
    """Two positions per trade: ``(role, price, won, count, ALIKE, ...)``, unpivoted from one scan."""
    side = lambda r: F.struct(F.lit(r).alias("role"), F.col(f"{r}_price").alias("price"), F.col(f"{r}_won").alias("won"))
    return rows.select(
        "count", ALIKE, *keep, F.explode(F.array(side("taker"), side("maker"))).alias("p")
    ).select("p.*", "count", ALIKE, *keep)


def maker_bets(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """The maker's bet by direction: ``(side, price, won, count, ALIKE)``; trades without a clear side are left out."""
    trades = trades if ALIKE in trades.columns else trades.withColumn(ALIKE, F.lit(1))
    rows = trades.join(resolved(markets).select("ticker", "result"), "ticker").where(F.col("taker_side").isin("yes", "no"))
    bought_yes = F.col("taker_side") == "no"
    return rows.select(
        on(bought_yes, F.lit("yes"), F.lit("no")).alias("side"), on(bought_yes, F.col("yes_price"), F.col("no_price")).alias("price"),
        on(F.col("result") == on(bought_yes, F.lit("yes"), F.lit("no")), 1).alias("won"), "count", ALIKE,
    )
