"""Queries p1 to p6: the general data problems over the prediction-market tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions.keys import fill_key, hash_key, id_key, ticker_key
from augury.operators import dedup, orphans, packed, rolling, skew, units
from augury.operators.lineage import cut
from augury.sources.tables import table

HOT_SHARE = 0.03


# 1. A few keys holding most records


def _keyed(spark: SparkSession, d: str, name: str, column: str) -> DataFrame:
    canonical = ticker_key(column) if name == "k_trades" else id_key(column)
    return table(spark, d, name).withColumn("hot_key", canonical)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Tickers and AMM addresses with at least 3 % of all stored rows of their table."""
    k = skew.hot_keys(_keyed(spark, d, "k_trades", "ticker").select("hot_key"), "hot_key", HOT_SHARE)
    p = skew.hot_keys(_keyed(spark, d, "p_legacy", "fpmm_address").select("hot_key"), "hot_key", HOT_SHARE)
    return k.select(F.lit("k_trades").alias("src"), "hot_key").unionByName(p.select(F.lit("p_legacy").alias("src"), "hot_key"))


def p1_ticker_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows and contracts of each ticker with the event of its market, by fragment and replicate."""
    trades = _keyed(spark, d, "k_trades", "ticker").select("hot_key", "count").where(F.col("hot_key").isNotNull())
    events = table(spark, d, "k_markets").groupBy(ticker_key("ticker").alias("hot_key")).agg(
        F.max(ticker_key("event_ticker")).alias("event_ticker")
    )
    plan = skew.plan_loads(trades, "hot_key")
    joined = skew.fragment_replicate_join(trades, events, "hot_key", "left", plan, keep_salt=True)
    parts = [F.count("*").alias("n"), F.sum("count").alias("c"), F.max("event_ticker").alias("e")]
    merges = [F.sum("n").alias("n_rows"), F.sum("c").alias("contracts"), F.max("e").alias("event_ticker")]
    return skew.balanced_totals(joined, "hot_key", parts, merges).withColumnRenamed("hot_key", "ticker")


def p1_address_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, buys and collateral of each AMM address of the legacy trades."""
    rows = _keyed(spark, d, "p_legacy", "fpmm_address").select(
        "hot_key", "is_buy", F.expr("try_cast(amount AS DECIMAL(38,0))").alias("amount")
    )
    parts = [F.count("*").alias("n"), F.count_if("is_buy").alias("b"), F.sum("amount").alias("a")]
    merges = [F.sum("n").alias("n_rows"), F.sum("b").alias("n_buys"), F.sum("a").cast("string").alias("amount")]
    return skew.balanced_totals(rows, "hot_key", parts, merges).withColumnRenamed("hot_key", "fpmm_address")


# 2. References to records that do not exist


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references of trades, AMM trades and markets, per table and month."""

    def part(name: str, src: str, key: Column, at: str = "_fetched_at") -> DataFrame:
        return table(spark, d, name).select(F.lit(src).alias("src"), key.alias("ref_key"), F.col(at).alias("at"))

    children = part("k_trades", "k_trades", ticker_key("ticker")).unionByName(part("p_legacy", "p_legacy", id_key("fpmm_address"))).unionByName(
        part("p_markets", "p_markets", id_key("market_maker_address"))
    )
    parents = part("k_markets", "k_trades", ticker_key("ticker")).unionByName(
        part("p_markets", "p_legacy", id_key("market_maker_address"))
    ).unionByName(part("p_collateral", "p_markets", id_key("fpmm_address")))
    child_of = {"k_markets": "k_trades", "p_markets": "p_legacy", "p_collateral": "p_markets"}
    src = F.create_map(*(F.lit(x) for kv in child_of.items() for x in kv))[F.col("scope")]
    key = F.when(F.col("scope") == "k_markets", ticker_key("ref_key")).otherwise(id_key("ref_key"))
    removals = table(spark, d, "removals").select(
        src.alias("src"), key.alias("ref_key"), F.col("removed_at").alias("at")
    ).where(F.col("src").isNotNull())
    return orphans.orphan_references(children, parents, removals)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of orphan keys per referring table, month and kind."""
    return p2_found(spark, d).groupBy("src", "ref_month", "kind").agg(F.count("*").alias("n_keys"))


# 3. Rolling totals over trailing periods


def _ticker_totals(spark: SparkSession, d: str, gaps_rising: tuple[int, int] | None = None) -> DataFrame:
    stored = table(spark, d, "k_trades")
    trades = stored.select(id_key("trade_id").alias("id"), ticker_key("ticker").alias("ticker"), "count", "created_time", "_fetched_at")
    days = rolling.daily(dedup.keep_first(trades, "id", "_fetched_at"), "ticker", "created_time", "count")
    return rolling.trailing_totals(days, (7, 30), gaps_rising, expected=rolling.entity_shards(stored, ticker_key("ticker"), "created_time"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Days without a trade on which the 7-day daily average is above the 30-day one."""
    rows = _ticker_totals(spark, d, gaps_rising=(7, 30))
    return rows.select(F.col("entity").alias("ticker"), _day("day").alias("trade_day"))


def _day(c: str) -> Column:
    return F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")


def _rolled(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("entity").alias("ticker"),
        _day("day").alias("trade_day"),
        F.col("n_rows").alias("n_trades"),
        "total_7",
        "total_30",
        F.round(F.col("total_7") / F.lit(7.0), 6).alias("avg_7"), F.round(F.col("total_30") / F.lit(30.0), 6).alias("avg_30"),
    )


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals and daily averages over 7 and 30 days for every ticker and day, idle days included."""
    return _rolled(_ticker_totals(spark, d))


def p3_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The totals that the trades fetched from 2024 on change: days with such a trade among their last 30.

    The trees of the trades stored before are kept in the shared folder; the late ones correct the nodes
    above their days, and the corrected trees answer.  A row without a fetch time counts as stored before.
    """
    trades = table(spark, d, "k_trades").select(
        id_key("trade_id").alias("id"), ticker_key("ticker").alias("ticker"), "count", "created_time", "_fetched_at"
    )
    first = dedup.keep_first(trades, "id", "_fetched_at")
    late = F.coalesce(F.col("_fetched_at") >= F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(False))
    both = first.withColumn("late", late)
    stored, corrections = (rolling.daily(both.where(c), "ticker", "created_time", "count") for c in (~F.col("late"), F.col("late")))
    totals = rolling.answer(rolling.correct_trees(cut(rolling.tree_table(stored)), corrections))
    changed = corrections.select("entity", F.explode(F.sequence(F.col("day"), F.col("day") + 29)).alias("day")).distinct()
    return _rolled(totals.join(changed, ["entity", "day"], "left_semi"))


# 4. Quantities recorded in different units


_fitted: dict[tuple, tuple] = {}


def _fit(name: str, df: DataFrame, *others: DataFrame, make: Callable[[], tuple]) -> tuple:
    """What was fitted on these very files in this application, else ``make()``; models are a few numbers each."""
    key = (df.sparkSession.sparkContext.applicationId, name, *(tuple(sorted(x.inputFiles())) for x in (df, *others)))
    if key not in _fitted:
        if len(_fitted) > 64:
            _fitted.clear()
        _fitted[key] = make()
    return _fitted[key]


def price_unit(spark: SparkSession, d: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``unit`` to trades, stored or streamed: ``power`` of their price (to hundredths of a cent), ``probability`` and ``sure``.

    The mixtures and the contexts of unit names are learnt from all stored trades.
    """
    stored, table_of = table(spark, d, "k_trades"), table(spark, d, "unit_defs")
    yes, both = F.col("yes_price"), F.col("yes_price").cast("long") + F.col("no_price")
    log = lambda c: F.log10(F.greatest(c, F.lit(1)).cast("double"))
    makes_dollar = lambda p: F.abs(both - F.lit(10 ** (4 - p))) <= 1

    def learn() -> tuple:
        defs = units.UnitTable.load(table_of, "k_trades", "yes_price")
        powers = defs.powers or [2]
        others = units.other_contexts(stored, defs.mentions(F.col("price_note")), both.isNotNull(), makes_dollar, powers)
        told = F.coalesce(defs.named(F.col("price_note"), others), defs.default(F.col("feed")))
        untold = stored.where(told.isNull() & yes.isNotNull())
        pair = units.fit_units(untold.where(F.col("no_price").isNotNull()), both, powers, 4.0)
        return defs, others, pair, units.fit_units(untold.where(F.col("no_price").isNull()), yes, powers, 3.6)

    defs, others, pair, single = _fit("price", stored, table_of, make=learn)
    told = F.struct(F.col("told").alias("power"), F.lit(1.0).alias("probability"), F.lit(True).alias("sure"))
    by_pair, by_price = pair.posterior(log(both), makes_dollar), single.posterior(log(yes))
    unit = F.when(F.col("told").isNotNull(), told).when(both.isNotNull(), by_pair).when(yes.isNotNull(), by_price)
    tell = F.coalesce(defs.named(F.col("price_note"), others), defs.default(F.col("feed")))
    return lambda df: df.withColumn("told", tell).withColumn("unit", unit)


def _price_units(spark: SparkSession, d: str) -> DataFrame:
    return price_unit(spark, d)(table(spark, d, "k_trades"))


def amount_unit(spark: SparkSession, d: str, fills: DataFrame | None = None) -> DataFrame:
    """Fills, stored ones unless given, with ``unit``: ``power`` of their maker amount (to millionths), ``probability`` and ``sure``.

    A share costs between half a cent and a dollar, so the amounts of both sides tell whether a unit fits.
    """
    stored, table_of = table(spark, d, "p_trades"), table(spark, d, "unit_defs")
    readable = (F.col("maker_amount") > 0) & (F.col("taker_amount") > 0)
    pays = F.col("maker_asset_id") == "0"
    ratio = F.log10(F.col("maker_amount").cast("double") / F.col("taker_amount"))
    paid = ratio + F.when(pays, 0.35).otherwise(-0.35)
    cents = lambda p: F.when(pays, ratio + p).otherwise(-ratio - p)
    fits = lambda p: cents(p).between(-2.4, 0.01)

    def learn() -> tuple:
        defs = units.UnitTable.load(table_of, "p_trades", "maker_amount")
        powers = defs.powers or [0]
        others = units.other_contexts(stored, defs.mentions(F.col("amount_note")), readable, fits, powers)
        told = F.coalesce(defs.named(F.col("amount_note"), others), defs.default(F.col("_contract")))
        return defs, others, units.fit_units(stored.where(told.isNull() & readable), F.pow(F.lit(10.0), paid), powers, 0.0)

    defs, others, mixture = _fit("amount", stored, table_of, make=learn)
    tell = F.coalesce(defs.named(F.col("amount_note"), others), defs.default(F.col("_contract")))
    told = F.struct(F.col("told").alias("power"), F.lit(1.0).alias("probability"), F.lit(True).alias("sure"))
    unit = F.when(F.col("told").isNotNull(), told).when(readable, mixture.posterior(paid))
    return (stored if fills is None else fills).withColumn("told", tell).withColumn("unit", unit)


def token_unit(spark: SparkSession, d: str) -> DataFrame:
    """Legacy trades with the ``number`` of their token text and its ``power`` (to 1e-18 tokens).

    An exponent of more than three digits counts as unreadable.
    """
    defs = units.UnitTable.load(table(spark, d, "unit_defs"), "p_legacy", "outcome_tokens")
    text = F.btrim("outcome_tokens", F.lit(" \t"))
    hexa = F.regexp_extract(text, r"^0[xX]0*([0-9a-fA-F]+)$", 1)
    plain = r"[+-]?\d+(?:[, ]+\d+)*(?:\.\d+)?"
    bare = F.regexp_extract(text, rf"^({plain})$", 1)
    mantissa = F.regexp_extract(text, r"^([+-]?\d+(?:\.\d+)?)[eE][+-]?\d+$", 1)
    exponent = F.expr("try_cast(regexp_extract(btrim(outcome_tokens, ' \t'), '[eE]([+-]?[0-9]{1,3})$', 1) AS INT)")
    rest = F.btrim(F.regexp_replace(text, defs.pattern(), " "), F.lit(" \t()[]:=")) if defs.names else F.lit("")
    worded = F.regexp_extract(rest, rf"^({plain})$", 1)
    clean = lambda c: F.regexp_replace(c, "[, ]", "")
    value = lambda n, p: F.struct(n.alias("number"), p.cast("int").alias("power"))
    read = (
        F.when(hexa != "", value(units.hex_text(hexa), F.lit(0)))
        .when(mantissa != "", value(units.shift_text(mantissa, exponent), F.lit(0)))
        .when(bare != "", value(clean(bare), F.when(bare.contains("."), 18).otherwise(0)))
        .when(worded != "", value(clean(worded), defs.named(text)))
    )
    return table(spark, d, "p_legacy").withColumn("read", read)


def _in_one_unit(spark: SparkSession, d: str) -> DataFrame:
    """``(src, rec_key, number, power, sure, usual, at)`` of all rows; null number or power: can't be read."""

    def part(rows: DataFrame, src: str, key: Column, number: Column, power: Column, sure: Column, usual: int) -> DataFrame:
        return rows.select(
            F.lit(src).alias("src"),
            key.alias("rec_key"),
            number.cast("string").alias("number"),
            power.alias("power"),
            F.coalesce(sure, F.lit(False)).alias("sure"),
            F.lit(usual).alias("usual"),
            F.col("_fetched_at").alias("at")
        )

    fill = fill_key("transaction_hash", "log_index")
    k = part(_price_units(spark, d), "k_trades", id_key("trade_id"), F.col("yes_price"), F.col("unit.power"), F.col("unit.sure"), 2)
    p = part(amount_unit(spark, d), "p_trades", fill, F.col("maker_amount"), F.col("unit.power"), F.col("unit.sure"), 0)
    t = part(token_unit(spark, d), "p_legacy", fill, F.col("read.number"), F.col("read.power"), F.col("read.power").isNotNull(), 0)
    return k.unionByName(p).unionByName(t)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records in another scale than the documented one, in the target unit, copies once."""
    cases = _in_one_unit(spark, d).where(F.col("number").isNotNull() & F.col("sure") & (F.col("power") != F.col("usual")))
    cases = cases.withColumn("row", F.coalesce("rec_key", F.monotonically_increasing_id().cast("string")))
    first = cases.groupBy("src", "row").agg(F.min(F.struct(F.col("at").isNull(), "at", "number", "power", "rec_key")).alias("r"))
    return first.select("src", "r.rec_key", units.shift_text(F.col("r.number"), F.col("r.power")).alias("val"))


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows per table and power of ten of their unit, readable or not, with uncertain ones flagged."""
    there = F.col("number").isNotNull()
    rows = _in_one_unit(spark, d).select("src", F.when(there, F.col("power")).alias("power"), (there & ~F.col("sure")).alias("uncertain"))
    return rows.groupBy("src", "power", "uncertain").agg(F.count("*").alias("n_rows"))


# 5. Messages delivered more than once


def _messages(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    k = table(spark, d, "k_trades").select(id_key("trade_id").alias("msg_key"), "_fetched_at")
    p = table(spark, d, "p_trades").select(fill_key("transaction_hash", "log_index").alias("msg_key"), "_fetched_at")
    return [("k_trades", k), ("p_trades", p)]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of trades and fills with more than one stored row."""
    k, p = (
        dedup.copy_counts(df, "msg_key", "_fetched_at").select(
            F.lit(src).alias("src"), "msg_key", "n_copies"
        ) for src, df in _messages(spark, d)
    )
    return k.unionByName(p)


def first_trades(spark: SparkSession, d: str) -> DataFrame:
    """Stored trades with their ``msg_key``, exactly one row per identifier: the first that arrived."""
    return dedup.keep_first(table(spark, d, "k_trades").withColumn("msg_key", id_key("trade_id")), "msg_key", "_fetched_at")


def first_fills(spark: SparkSession, d: str) -> DataFrame:
    """Stored fills with their ``msg_key``, exactly one row per identifier: the first that arrived."""
    rows = table(spark, d, "p_trades").withColumn("msg_key", fill_key("transaction_hash", "log_index"))
    return dedup.keep_first(rows, "msg_key", "_fetched_at")


def p5_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades, exactly one row per identifier: the first that arrived."""
    kept = first_trades(spark, d)
    return kept.select("msg_key", ticker_key("ticker").alias("ticker"), "count", "yes_price", "no_price", "created_time", "_fetched_at")


def p5_fills(spark: SparkSession, d: str) -> DataFrame:
    """Fills, exactly one row per transaction hash and log index: the first that arrived."""
    return first_fills(spark, d).select(
        "msg_key", "block_number", hash_key("order_hash").alias("order_hash"), "maker_amount", "taker_amount", "fee", "_fetched_at"
    )


def p5_admitted(spark: SparkSession, d: str) -> DataFrame:
    """What the batches from 2024 on add to the trades stored before: new identifiers only.

    A row without a fetch time counts as stored before, as in :func:`p3_corrected`.
    """
    rows = table(spark, d, "k_trades").select(id_key("trade_id").alias("msg_key"), "trade_id", "count", "_fetched_at")
    late = F.coalesce(F.col("_fetched_at") >= F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(False))
    return dedup.admit(rows.where(~late), rows.where(late), "msg_key", "_fetched_at").select("msg_key", "count", "_fetched_at")


# 6. Several values packed in one field


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of the packed fields of the markets, with its position."""
    markets = table(spark, d, "p_markets").select(F.col("id").alias("market_id"), *packed.FIELDS)
    return packed.split_packed(markets, "market_id", packed.FIELDS)
