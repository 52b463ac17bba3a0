"""Queries for single relational operators that the analyses are built from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.functions.blocks import interpolate, iso_z
from augury.functions.classify import DEFAULT_RULES, category, classify
from augury.functions.keys import id_key, ticker_key
from augury.functions.numbers import r6, ratio
from augury.operators.dedup import keep_first
from augury.plans import charts, statistics, venue_k, venue_p, views
from augury.plans.training import price_unit
from augury.sources.tables import optional_table, stream_table, table
from augury.streaming.incremental import run_to_memory


def maker_counterparty_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Beside each price the makers' excess at the complementary price, 0 where there is none."""
    r = venue_k.maker_vs_taker_returns(views.k_trades(spark, d), views.k_markets(spark, d)).select("price", "taker_excess", "maker_excess")
    other = r.select((100 - F.col("price")).alias("price"), F.col("maker_excess").alias("counterparty_excess"))
    return r.join(other, "price", "left").select(
        "price", "taker_excess", F.coalesce("counterparty_excess", F.lit(0.0)).alias("counterparty_excess")
    )


def category_extract(spark: SparkSession, d: str) -> DataFrame:
    """Markets per category, with and without the guard for names that do not match."""
    m = views.k_markets(spark, d)
    return m.groupBy(
        category("event_ticker").alias("category"), category("event_ticker", guard=False).alias("unguarded")
    ).agg(F.count("*").alias("n"))


def classifier_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct category with its group, category and subcategory by the first rule that matches."""
    cats = views.k_markets(spark, d).select(category("event_ticker").alias("name")).distinct()
    return cats.select("name", classify(F.col("name")).alias("c")).select("name", "c.group", "c.category", "c.subcategory")


def json_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Token to outcome of resolved markets, from JSON fields; other writings are skipped."""
    return venue_p.token_resolution(views.p_markets(spark, d))


def computed_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Fills per outcome, joined on a key that depends on who paid."""
    fills = table(spark, d, "p_trades")
    key = F.when(F.col("maker_asset_id") == "0", F.col("taker_asset_id")).otherwise(F.col("maker_asset_id"))
    return fills.select(key.alias("token_id")).join(venue_p.token_resolution(views.p_markets(spark, d)), "token_id").groupBy("won").agg(
        F.count("*").alias("n"), F.countDistinct("token_id").alias("n_tokens")
    )


def lower_key_join(spark: SparkSession, d: str) -> DataFrame:
    """AMM trades per outcome of their market, joined on the lower-case address."""
    amm = venue_p.amm_resolution(views.p_markets(spark, d))
    return views.p_legacy(spark, d).withColumn(
        "fpmm_address", F.lower("fpmm_address")
    ).join(amm, "fpmm_address").groupBy("winner", "outcome_index").agg(F.count("*").alias("n"))


def counterparty_price_round(spark: SparkSession, d: str) -> DataFrame:
    """Rounded price and separately rounded complement of fills."""
    rows = views.p_fills(spark, d).where((F.col("maker_amount") > 0) & (F.col("taker_amount") > 0) & (F.col("maker_asset_id") == "0"))
    cents = 100.0 * F.col("maker_amount").cast("double") / F.col("taker_amount").cast("double")
    return rows.groupBy(
        F.round(cents, 0).alias("price"), F.round(100.0 - cents, 0).alias("complement")
    ).agg(F.count("*").alias("n")).where(F.col("price").between(0, 100))


def decile_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Takers' calibration per ten cents on the order-book venue."""
    rows = views.traded(views.compact(views.k_trades(spark, d)), views.k_markets(spark, d)).where(F.col("taker_price").between(1, 99))
    low, n = (F.floor(F.col("taker_price") / 10.0) * 10).cast("long"), F.col(views.ALIKE)
    return rows.groupBy(low.alias("bucket_low")).agg(
        F.sum(n).alias("n"),
        F.sum(n * F.col("taker_won")).alias("wins"),
        r6(ratio(F.sum(n * F.col("taker_price")), F.sum(n))).alias("mean_predicted")
    )


def time_bucket_join(spark: SparkSession, d: str) -> DataFrame:
    """Fills per month by the time of their bucket of blocks."""
    fills = table(spark, d, "p_trades").groupBy(
        F.expr(f"block_number div {venue_p.BLOCKS_PER_BUCKET}").alias("bucket")
    ).agg(F.count("*").alias("n"))
    joined = fills.join(venue_p.bucket_times(table(spark, d, "p_blocks")), "bucket")
    return joined.groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n"))


def events_per_block_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of both trade tables per block."""
    return table(spark, d, "p_trades").select("block_number").unionByName(
        table(spark, d, "p_legacy").select("block_number")
    ).groupBy("block_number").agg(F.count("*").alias("n"))


def usdc_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """AMM trades per address of USDC markets only."""
    usdc = venue_p.usdc_addresses(table(spark, d, "p_collateral"))
    return views.p_legacy(spark, d).join(usdc, "fpmm_address", "left_semi").groupBy("fpmm_address").agg(F.count("*").alias("n"))


def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The first fetch of each market."""
    rows = table(spark, d, "k_markets").select(
        ticker_key("ticker").alias("ticker"), "status", "result", "_fetched_at"
    ).where(F.col("ticker").isNotNull())
    return keep_first(rows, "ticker", "_fetched_at", ["status", "result"])


def asof_latest(spark: SparkSession, d: str) -> DataFrame:
    """For each trade the market's status as of its fetch: trades per status, unknown before the first fetch.

    Trades of one ticker and fetch are one row from the start, so a hot ticker's windows run over fetches.
    """
    key = ticker_key("ticker").alias("ticker")
    trades = table(spark, d, "k_trades").groupBy(key, F.col("_fetched_at").alias("seen")).agg(F.count("*").alias("is_trade")).select(
        "ticker", "seen", F.lit(None).cast("string").alias("status"), "is_trade"
    )
    fetches = table(spark, d, "k_markets").groupBy(
        key, F.col("_fetched_at").alias("seen")
    ).agg(F.min("status").alias("status")).withColumn("is_trade", F.lit(0).cast("long"))
    rows = trades.unionByName(fetches).where(F.col("ticker").isNotNull())
    month = F.date_format("seen", "yyyy-MM")
    w = Window.partitionBy("ticker", "month").orderBy("seen", "is_trade").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("month", month).withColumn("here", F.last("status", ignorenulls=True).over(w))
    ends = within.groupBy("ticker", "month").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.struct("seen", "status"))).alias("end")
    )
    before = Window.partitionBy("ticker").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)  # a row per ticker and month
    carried = ends.select("ticker", "month", F.last("end", ignorenulls=True).over(before).alias("carried"))
    joined = within.where(F.col("is_trade") > 0).join(carried, ["ticker", "month"])
    return joined.groupBy(F.coalesce("here", "carried", F.lit("unknown")).alias("status")).agg(F.sum("is_trade").alias("n"))


def block_time_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """A time for every block between the stored ones, summed up per 100,000 blocks."""
    blocks = venue_p.block_times(table(spark, d, "p_blocks")).select(
        "block_number", F.unix_seconds(F.expr("try_cast(timestamp AS TIMESTAMP)")).alias("seconds")
    )
    rows = interpolate(blocks)
    out = rows.groupBy(F.expr("block_number div 100000").alias("part")).agg(
        F.count("*").alias("n_blocks"), F.min("seconds").alias("lo"), F.max("seconds").alias("hi"), F.sum("seconds").alias("total")
    )
    return out.select("part", "n_blocks", iso_z("lo").alias("first_time"), iso_z("hi").alias("last_time"), "total")


def equal_width_bins(spark: SparkSession, d: str) -> DataFrame:
    """Orders in 20 equal-width bins of their total price."""
    rows = statistics.with_bin(table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("x")), "x", 20, "bin")
    return rows.groupBy("bin").agg(F.count("*").alias("n"))


def optional_source_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows per source where one of three sources may be absent."""
    schema = T.StructType([T.StructField("block_number", T.LongType())])
    parts = [optional_table(spark, d, n, schema).select(F.lit(n).alias("src")) for n in ("p_trades", "p_legacy", "p_old_trades")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("src").agg(F.count("*").alias("n"))


def json_map_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Values of JSON objects by key."""
    props = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return props.groupBy("key", "value").agg(F.count("*").alias("n"))


def distinct_union_prices(spark: SparkSession, d: str) -> DataFrame:
    """All prices that occur on either side."""
    t = views.k_trades(spark, d)
    return t.select(F.col("yes_price").alias("price")).union(t.select("no_price")).where(F.col("price").between(1, 99)).distinct()


def quarter_labels(spark: SparkSession, d: str) -> DataFrame:
    """Contracts per labelled quarter, with the share of the year's contracts."""
    t = views.k_contracts(spark, d).where(F.col("created_time").isNotNull())
    per = t.groupBy(F.year("created_time").alias("y"), F.quarter("created_time").alias("q")).agg(F.sum("count").alias("contracts"))
    share = r6(ratio(F.col("contracts"), F.sum("contracts").over(Window.partitionBy("y"))))
    return per.select(
        F.concat(F.col("y").cast("string"), F.lit(" Q"), F.col("q").cast("string")).alias("quarter"),
        F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(" '"), F.lpad((F.col("y") % 100).cast("string"), 2, "0")).alias("short"),
        "contracts",
        share.alias("year_share")
    )


def fill_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Derived attributes of fills: who buys, price, size and dollars, summed per side."""
    buys = F.col("maker_asset_id") == "0"
    rows = views.p_fills(spark, d).where((F.col("maker_amount") > 0) & (F.col("taker_amount") > 0))
    usdc, tokens = F.when(
        buys, F.col("maker_amount")
    ).otherwise(F.col("taker_amount")).cast("double"), F.when(buys, F.col("taker_amount")).otherwise(F.col("maker_amount")).cast("double")
    out = rows.select(
        F.when(buys, "BUY").otherwise("SELL").alias("side"),
        (usdc / tokens).alias("price"),
        F.floor(tokens / 1e6).cast("decimal(38,0)").alias("size")
    )
    return out.groupBy("side").agg(
        F.count("*").alias("n"), F.round(F.max("price"), 4).alias("max_price"), F.sum("size").cast("string").alias("tokens")
    )


def address_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct traders per leading hex digit of their address."""
    return table(spark, d, "p_legacy").select(id_key("trader").alias("t")).where(F.col("t").startswith("0x")).groupBy(
        F.substring("t", 3, 1).alias("digit")
    ).agg(F.countDistinct("t").alias("n"))


def arg_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The prices with the best and the worst expected value on either side; ties go to the lowest price."""
    ev = venue_k.ev_yes_vs_no(views.k_trades(spark, d), views.k_markets(spark, d))
    pick = lambda side, sign: F.max_by(
        "price", F.when(F.col(f"{side}_ev").isNotNull(), F.struct(sign * F.col(f"{side}_ev"), -F.col("price")))
    )
    return ev.agg(
        *(
            pick(side, sign).alias(f"{name}_{side}") for side in ("yes", "no") for name, sign in (
                ("best", F.lit(1.0)), ("worst", F.lit(-1.0))
            )
        )
    )


def top_k_events(spark: SparkSession, d: str) -> DataFrame:
    """The eight events with the largest volume; ties by name."""
    per = views.k_markets(spark, d).where(F.col("event_ticker").isNotNull()).groupBy("event_ticker").agg(
        F.sum("volume").alias("volume"), F.count("*").alias("n_markets")
    )
    return per.orderBy(F.col("volume").desc_nulls_last(), "event_ticker").limit(8)


def ranks_within_group(spark: SparkSession, d: str) -> DataFrame:
    """Position (from 0) and size of the category's group, by volume."""
    cats = venue_k._categories(views.k_markets(spark, d), DEFAULT_RULES).select(F.col("c.group").alias("group"), "name", "total_volume")
    order = Window.partitionBy("group").orderBy(F.col("total_volume").desc(), "name")
    return cats.select(
        "group", "name", (F.row_number().over(order) - 1).alias("pos"), F.count("*").over(Window.partitionBy("group")).alias("size")
    )


def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Trades and contracts per price in whole cents, counted by a stream over the stored files; no row is left out."""
    cents = price_unit(spark, d)(stream_table(spark, d, "k_trades")).select(views.in_cents("yes_price"), "count")
    counts = cents.groupBy(F.col("yes_price").alias("price")).agg(F.count("*").alias("n"), F.sum("count").alias("contracts"))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    name = f"augury_stream_{uuid.uuid4().hex}"
    return run_to_memory(counts, name, checkpoint=f"{shared}/{name}" if shared else None)


def chart_spec_json(spark: SparkSession, d: str) -> DataFrame:
    """The chart of the calibration by price, as one JSON text."""
    by_price = venue_k.win_rate_by_price(views.k_trades(spark, d), views.k_markets(spark, d)).where(F.col("price").isNotNull())
    rows = [r.asDict() for r in by_price.collect()]  # about 100 prices
    return spark.createDataFrame([(charts.line(rows, "price", "win_rate", x_label="Price (cents)").to_json(),)], "chart string")
