"""The analyses of the on-chain venue and the one across both venues.

Market resolution is a relation, not a driver-side dictionary: packed prices and token ids are parsed in
the plan and joined to fills, so the optimiser sees the whole query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions.numbers import r6, ratio
from augury.plans.views import ALIKE, compact, on, positions, traded

# Blocks per bucket of the approximate time join; JSON that is read strictly.
BLOCKS_PER_BUCKET = 10_800
STRICT = {"allowSingleQuotes": "false"}


def json_list(c: str) -> Column:
    """A JSON array as text items; null for anything else (single quotes, braces, encoded twice)."""
    return F.from_json(F.col(c), "array<string>", STRICT)


def resolution(markets: DataFrame) -> DataFrame:
    """``(id, tokens, address, winner)`` of closed two-way markets with one price above 0.99 and one below 0.01."""
    rows = markets.where("closed").select(
        "id",
        json_list("outcome_prices").alias("prices"),
        json_list("clob_token_ids").alias("tokens"),
        F.col("market_maker_address").alias("address")
    )
    price = lambda i: F.expr(f"try_cast(get(prices, {i}) AS DOUBLE)")
    rows = rows.where(F.size("prices") == 2)
    winner = F.when((price(0) > 0.99) & (price(1) < 0.01), 0).when((price(1) > 0.99) & (price(0) < 0.01), 1)
    return rows.select("id", "tokens", "address", winner.alias("winner")).where(F.col("winner").isNotNull())


def token_resolution(markets: DataFrame) -> DataFrame:
    """``(token_id, won)``; a token of several markets takes the market with the largest id."""
    rows = resolution(markets).where(F.size("tokens") == 2).select(
        "id", "winner", F.posexplode("tokens").alias("pos", "token_id")
    ).where(F.col("token_id").isNotNull())
    return rows.groupBy("token_id").agg(F.max_by(F.col("pos") == F.col("winner"), F.struct("id", "pos")).alias("won"))


def amm_resolution(markets: DataFrame, collateral: DataFrame | None = None) -> DataFrame:
    """``(fpmm_address, winner)`` of resolved markets with an AMM, of USDC ones if a lookup is given."""
    rows = resolution(markets).where(F.col("address").isNotNull()).groupBy(
        F.lower("address").alias("fpmm_address")
    ).agg(F.max_by("winner", "id").alias("winner"))
    return rows if collateral is None else rows.join(usdc_addresses(collateral), "fpmm_address", "left_semi")


def usdc_addresses(collateral: DataFrame) -> DataFrame:
    return collateral.where(F.col("collateral_symbol") == "USDC").select(
        F.lower(F.btrim("fpmm_address", F.lit(" \t"))).alias("fpmm_address")
    ).distinct()


def fill_positions(trades: DataFrame, markets: DataFrame, *keep: str) -> DataFrame:
    """Buyer and seller of every order-book fill of a resolved token: ``(price, won, ...)``, one scan.

    The seller's price is rounded on its own: ``round(100 - p)`` differs from ``100 - round(p)`` at halves.
    """
    pays = F.col("maker_asset_id") == "0"
    rows = trades.where((F.col("taker_amount") > 0) & (F.col("maker_amount") > 0)).withColumn(
        "token_id", on(pays, F.col("taker_asset_id"), F.col("maker_asset_id"))
    )
    usdc, tokens = on(pays, F.col("maker_amount"), F.col("taker_amount")), on(pays, F.col("taker_amount"), F.col("maker_amount"))
    cents = 100.0 * usdc.cast("double") / tokens.cast("double")
    return _two_sides(rows.join(token_resolution(markets), "token_id"), cents, F.col("won"), *keep)


def amm_positions(legacy: DataFrame, markets: DataFrame, collateral: DataFrame | None = None, *keep: str) -> DataFrame:
    """Buyer and seller of every AMM trade of a resolved market; unreadable amounts are left out."""
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    rows = legacy.withColumn("a", number("amount")).withColumn("t", number("outcome_tokens")).where(
        (F.col("t") > 0) & F.col("a").isNotNull()
    )
    rows = rows.withColumn("fpmm_address", F.lower("fpmm_address")).join(amm_resolution(markets, collateral), "fpmm_address")
    return _two_sides(rows, 100.0 * F.col("a") / F.col("t"), F.col("outcome_index") == F.col("winner"), *keep)


def _two_sides(rows: DataFrame, cents: Column, won: Column, *keep: str) -> DataFrame:
    side = lambda p, w: F.struct(F.round(p, 0).alias("price"), F.coalesce(w, F.lit(False)).alias("won"))
    rows = rows.withColumn("__c", cents).withColumn("__w", won)
    return rows.select(
        *keep, F.explode(F.array(side(F.col("__c"), F.col("__w")), side(100.0 - F.col("__c"), ~F.col("__w")))).alias("s")
    ).select(*keep, "s.*").where(F.col("price").between(1.0, 99.0))


def all_positions(
    trades: DataFrame, markets: DataFrame, legacy: DataFrame | None = None, collateral: DataFrame | None = None, *keep: str
) -> DataFrame:
    """Order-book and, where the legacy table is given, AMM positions."""
    rows = fill_positions(trades, markets, *keep)
    return rows if legacy is None else rows.unionByName(amm_positions(legacy, markets, collateral, *keep))


def win_rate_by_price(
    trades: DataFrame, markets: DataFrame, legacy: DataFrame | None = None, collateral: DataFrame | None = None
) -> DataFrame:
    """Calibration per price in cents over both trade tables."""
    n, w = F.count("*"), F.count_if("won")
    return all_positions(trades, markets, legacy, collateral).groupBy("price").agg(
        n.alias("total_trades"), w.alias("wins"), r6(100.0 * ratio(w, n)).alias("win_rate")
    ).orderBy("price")


def calibration_by_bucket(
    trades: DataFrame, markets: DataFrame, legacy: DataFrame | None = None, collateral: DataFrame | None = None
) -> DataFrame:
    """Calibration per ten cents."""
    n, w = F.count("*"), F.count_if("won")
    rows = all_positions(trades, markets, legacy, collateral)
    low = (F.floor(F.col("price") / 10.0) * 10).cast("double")
    return rows.groupBy(low.alias("bucket_low")).agg(
        n.alias("total_trades"), w.alias("wins"), r6(F.avg("price")).alias("mean_predicted"), r6(100.0 * ratio(w, n)).alias("actual_rate")
    ).orderBy("bucket_low")


def calibration_metrics(by_price: DataFrame) -> DataFrame:
    """Brier score, log-loss and expected calibration error of a table (price, total_trades, wins); one row."""
    p = F.col("price") / 100.0
    lose = F.col("total_trades") - F.col("wins")
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1.0 - 1e-6))
    n = F.sum("total_trades").cast("double")
    brier = F.sum(F.col("wins") * (p - 1.0) * (p - 1.0) + lose * p * p) / n
    loss = -F.sum(F.col("wins") * F.log(q) + lose * F.log(1.0 - q)) / n
    ece = F.sum(F.abs(ratio(F.col("wins"), F.col("total_trades")) - p) * F.col("total_trades")) / n
    return by_price.agg(
        F.round(brier, 4).alias("brier_score"),
        F.round(loss, 4).alias("log_loss"),
        F.round(ece, 4).alias("ece"),
        F.sum("total_trades").alias("total_trades")
    )


def bucket_metrics(by_bucket: DataFrame) -> DataFrame:
    """ECE and MCE in percent, Brier score and number of buckets of a table by bucket; one row."""
    p, n = F.col("mean_predicted") / 100.0, F.sum("total_trades").cast("double")
    gap = F.abs(F.col("actual_rate") - F.col("mean_predicted"))
    brier = F.sum(F.col("wins") * (p - 1.0) * (p - 1.0) + (F.col("total_trades") - F.col("wins")) * p * p) / n
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return by_bucket.agg(
        zero(F.round(F.sum(gap * F.col("total_trades")) / n, 2)).alias("ece"),
        zero(F.round(F.max(gap), 2)).alias("mce"),
        F.round(brier, 4).alias("brier_score"),
        F.coalesce(F.sum("total_trades"), F.lit(0)).alias("total_trades"), F.count("*").alias("num_buckets"),
    )


def utc(c: str) -> Column:
    """An ISO 8601 text with any offset as UTC clock time, whatever the session's zone; null if unreadable."""
    seconds = F.unix_micros(F.expr(f"try_cast({c} AS TIMESTAMP)")) / 1_000_000
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def block_times(blocks: DataFrame) -> DataFrame:
    """One row per block; repeated rows of a resumed ingest fall together."""
    return blocks.groupBy("block_number").agg(F.min("timestamp").alias("timestamp"))


def trades_over_time(trades: DataFrame, legacy: DataFrame | None, blocks: DataFrame) -> DataFrame:
    """Fills and AMM trades per block that has a time."""
    rows = trades.select("block_number")
    rows = rows if legacy is None else rows.unionByName(legacy.select("block_number"))
    counts = rows.groupBy("block_number").agg(F.count("*").alias("trade_count"))
    return counts.join(block_times(blocks), "block_number").select(
        "block_number", "timestamp", "trade_count", utc("timestamp").alias("datetime")
    ).orderBy("block_number")


def bucket_times(blocks: DataFrame) -> DataFrame:
    """The time of the first block of each bucket of 10,800 blocks."""
    return blocks.groupBy(F.expr(f"block_number div {BLOCKS_PER_BUCKET}").alias("bucket")).agg(
        F.min_by("timestamp", F.struct("block_number", "timestamp")).alias("t")
    ).select("bucket", utc("t").alias("at"))


def volume_over_time(trades: DataFrame, legacy: DataFrame, blocks: DataFrame, collateral: DataFrame) -> DataFrame:
    """Quarterly outcome tokens of fills with a USDC leg plus collateral of USDC AMM trades."""
    maker, taker = F.col("maker_asset_id") == "0", F.col("taker_asset_id") == "0"
    fills = trades.where(maker | taker).select(
        "block_number", F.round(on(maker, F.col("taker_amount"), F.col("maker_amount")), 0).cast("decimal(38,0)").alias("v")
    )
    amm = legacy.join(usdc_addresses(collateral), "fpmm_address", "left_semi").select(
        "block_number", F.expr("try_cast(amount AS DECIMAL(38,0))").alias("v")
    )
    per_bucket = fills.unionByName(amm).groupBy(F.expr(f"block_number div {BLOCKS_PER_BUCKET}").alias("bucket")).agg(F.sum("v").alias("v"))
    quarter = F.date_trunc("quarter", "at").cast("timestamp_ntz")
    return per_bucket.join(bucket_times(blocks), "bucket").groupBy(quarter.alias("quarter")).agg(
        r6(F.sum("v").cast("double") / 1e6).alias("volume_usd")
    ).orderBy("quarter")


def daily_k(trades: DataFrame, markets: DataFrame) -> DataFrame:
    days = compact(trades.where(F.col("created_time").isNotNull()).withColumn("day", F.to_date("created_time")), "day")
    rows = positions(traded(days, markets), "day").where(F.col("price").between(1, 99))
    return rows.groupBy("day", F.col("price").cast("int").alias("price")).agg(
        F.sum(ALIKE).alias("n"), F.sum(F.col(ALIKE) * F.col("won")).alias("w")
    )


def daily_p(trades: DataFrame, markets: DataFrame, legacy: DataFrame | None, blocks: DataFrame, collateral: DataFrame | None) -> DataFrame:
    rows = all_positions(trades, markets, legacy, collateral, "block_number")
    per_bucket = rows.groupBy(
        F.expr(f"block_number div {BLOCKS_PER_BUCKET}").alias("bucket"), F.col("price").cast("int").alias("price")
    ).agg(F.count("*").alias("n"), F.count_if("won").alias("w"))
    return per_bucket.join(bucket_times(blocks), "bucket").groupBy(F.to_date("at").alias("day"), "price").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w")
    )


def cumulative(daily: DataFrame) -> DataFrame:
    """Running totals per price on every day with trades: ``(day, price, total, wins, day_total)``.

    ``daily`` has at most 99 prices per day; the windows run over these sums, never over trades.
    """
    run = Window.partitionBy("price").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    cells = daily.select("day").distinct().join(daily.select("price").distinct(), how="cross")  # days x at most 99 prices
    dense = cells.join(daily, ["day", "price"], "left")
    dense = dense.withColumn(
        "total", F.sum(F.coalesce("n", F.lit(0))).over(run)
    ).withColumn("wins", F.sum(F.coalesce("w", F.lit(0))).over(run)).where(F.col("total") > 0)
    return dense.withColumn(
        "day_total", F.sum("total").over(Window.partitionBy("day"))
    ).select("day", "price", "total", "wins", "day_total")


def kept_days(by_venue: DataFrame, least: int = 1000) -> DataFrame:
    """Days on which some venue has ``least`` cumulative positions, every second one from the first."""
    days = by_venue.groupBy("day").agg(F.max("day_total").alias("m")).where(F.col("m") >= least).select("day")
    numbered = days.withColumn("k", F.row_number().over(Window.orderBy("day")))  # one row per calendar day
    return numbered.where(F.col("k") % 2 == 1).select("day", ((F.col("k") + 1) / 2).cast("long").alias("frame"))


def snapshots(k: DataFrame, p: DataFrame) -> DataFrame:
    """Running totals of both venues: ``(platform, day, price, total, wins, day_total)``."""
    return cumulative(k).withColumn("platform", F.lit("kalshi")).unionByName(cumulative(p).withColumn("platform", F.lit("polymarket")))


def win_rate_by_price_animated(k: DataFrame, p: DataFrame, least: int = 1000) -> DataFrame:
    """Both venues' cumulative calibration on the last kept day; a venue without trades that day has no rows.

    ``k`` and ``p`` are the daily sums of :func:`daily_k` and :func:`daily_p`.
    """
    rows = snapshots(k, p)
    last = F.broadcast(kept_days(rows, least).agg(F.max("day").alias("day")))
    return rows.join(last, "day").select(
        "platform", "price", "total", "wins", r6(100.0 * ratio(F.col("wins"), F.col("total"))).alias("win_rate")
    )


def animation_frames(k: DataFrame, p: DataFrame, least: int = 1000, pause: int = 10) -> DataFrame:
    """``(frame, platform, price, total, wins, win_rate)``: each kept day shows every venue's latest totals.

    A venue without trades on the day shows its last day before (as-of); before its first day it is
    absent.  The last day is repeated for ``pause`` frames.
    """
    rows = snapshots(k, p)
    kept = kept_days(rows, least)
    held = rows.select("platform", "day").distinct().withColumn("seen", F.col("day"))
    asked = kept.join(rows.select("platform").distinct(), how="cross").select("platform", "day", F.lit(None).cast("date").alias("seen"), "frame")  # two venues
    both = held.withColumn("frame", F.lit(None).cast("long")).unionByName(asked)
    order = Window.partitionBy("platform").orderBy("day", F.col("frame").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # a row per day
    asof = both.withColumn("seen", F.last("seen", ignorenulls=True).over(order)).where(
        F.col("frame").isNotNull() & F.col("seen").isNotNull()
    )
    top = asof.withColumn("last", F.max("frame").over(Window.partitionBy()))  # a row per frame and venue
    shown = top.withColumn(
        "frame", F.explode(F.when(F.col("frame") == F.col("last"), F.sequence("frame", F.col("frame") + pause)).otherwise(F.array("frame")))
    )
    found = shown.select("platform", F.col("seen").alias("day"), "frame").join(rows, ["platform", "day"])
    return found.select("frame", "platform", "price", "total", "wins", r6(100.0 * ratio(F.col("wins"), F.col("total"))).alias("win_rate"))
