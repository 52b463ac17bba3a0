"""The nineteen analyses of the order-book venue; each takes trades and markets and gives a lazy frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions.classify import DEFAULT_RULES, Rule, category, classify
from augury.functions.numbers import r6, ratio, variance
from augury.plans.views import ALIKE, compact, maker_bets, on, positions, sized, traded

COUNT, PRICE, WON = "count", "price", "won"
EXCESS = "__x"  # 100 * won - price, an int
# The price buckets in cents.
BUCKETS = ((1, 10), (11, 20), (21, 30), (31, 40), (41, 50), (51, 60), (61, 70), (71, 80), (81, 90), (91, 99))


def rows_() -> Column:
    """Number of rows."""
    return F.count("*")


def _excess(df: DataFrame) -> DataFrame:
    return df.withColumn(EXCESS, F.col(WON) * 100 - F.col(PRICE))


def _sums(where: Column | None = None, prefix: str = "") -> list[Column]:
    """Exact integer sums that every rate, mean, variance and volume is made of.

    ``priced`` and ``priced_contracts`` leave out trades without a price, which have no excess.
    """
    pick = (lambda c: F.when(where, c)) if where is not None else (lambda c: c)
    x, n, f = F.col(EXCESS), F.col(COUNT), F.col(ALIKE)
    return [
        F.coalesce(F.sum(pick(f)), F.lit(0)).alias(f"{prefix}n"),
        F.sum(pick(f * F.col(WON))).alias(f"{prefix}wins"),
        F.coalesce(F.sum(pick(F.when(x.isNotNull(), f))), F.lit(0)).alias(f"{prefix}priced"),
        F.sum(pick(F.when(x.isNotNull(), n))).alias(f"{prefix}priced_contracts"),
        F.sum(pick(f * x)).alias(f"{prefix}x"),
        F.sum(pick(f * x * x)).alias(f"{prefix}xx"),
        F.sum(pick(n)).alias(f"{prefix}contracts"),
        F.sum(pick(n * F.col(PRICE))).alias(f"{prefix}cents"),
        F.sum(pick(n * x)).alias(f"{prefix}pnl"),
        F.sum(pick(n * F.col(WON))).alias(f"{prefix}won_contracts"),
    ]


def _mean_excess(p: str = "") -> Column:
    return ratio(F.col(f"{p}x"), F.col(f"{p}priced")) / 100.0


def _var_excess(p: str = "", ddof: int = 0) -> Column:
    return variance(F.col(f"{p}xx"), F.col(f"{p}x"), F.col(f"{p}priced"), ddof) / 10_000.0


def _interval(df: DataFrame, mean: str, spread: Column) -> DataFrame:
    df = df.withColumn("se", spread)
    return df.withColumn("ci_lower", F.col(mean) - 1.96 * F.col("se")).withColumn("ci_upper", F.col(mean) + 1.96 * F.col("se"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def win_rate_by_price(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Calibration over both sides of each trade; no price gate."""
    rows = positions(traded(compact(trades), markets))
    n, w = F.sum(ALIKE), F.sum(F.col(ALIKE) * F.col(WON))
    return _rounded(
        rows.groupBy(PRICE).agg(
            n.alias("total_trades"), w.alias("wins"), (100.0 * ratio(w, n)).alias("win_rate")
        ).orderBy(F.col(PRICE).asc_nulls_last())
    )


def mispricing_by_price(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Win rates against the price for takers, makers and both; prices with both roles."""
    rows = positions(traded(compact(trades), markets)).where(F.col(PRICE).between(1, 99))
    role = lambda r: F.col("role") == r
    aggs = []
    for name, cond in (("taker", role("taker")), ("maker", role("maker")), ("combined", F.lit(True))):
        n, w = F.coalesce(F.sum(F.when(cond, F.col(ALIKE))), F.lit(0)), F.sum(F.when(cond, F.col(ALIKE) * F.col(WON)))
        aggs += [n.alias(f"{name}_trades"), w.alias(f"{name}_wins"), (100.0 * ratio(w, n)).alias(f"{name}_win_rate")]
    df = rows.groupBy(PRICE).agg(*aggs).where((F.col("taker_trades") > 0) & (F.col("maker_trades") > 0))
    p = F.col(PRICE).cast("double")
    df = df.withColumn("implied_probability", p)
    for suffix, f in (("pct", lambda w: (w - p) / p * 100.0), ("pp", lambda w: w - p)):
        for name in ("taker", "maker", "combined"):
            df = df.withColumn(f"{name}_mispricing_{suffix}", f(F.col(f"{name}_win_rate")))
    return _rounded(df.orderBy(PRICE))


def maker_vs_taker_returns(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Excess returns of both roles per price, with standard errors and z (p-values: ``plans.statistics``)."""
    rows = _excess(positions(traded(compact(trades), markets)).where(F.col(PRICE).between(1, 99)))
    sums = rows.groupBy(PRICE).agg(
        *_sums(F.col("role") == "taker", "t_"), *_sums(F.col("role") == "maker", "m_")
    ).where((F.col("t_n") > 0) & (F.col("m_n") > 0))
    out = [F.col(PRICE)]
    for name, p in (("taker", "t_"), ("maker", "m_")):
        out += [
            ratio(F.col(f"{p}wins"), F.col(f"{p}n")).alias(f"{name}_win_rate"),
            (F.col(PRICE) / 100.0).alias(f"{name}_expected"),
            _mean_excess(p).alias(f"{name}_excess"),
            _var_excess(p).alias(f"{name}_var"),
            F.col(f"{p}n").alias(f"{name}_n"),
            (F.col(f"{p}cents") / 100.0).alias(f"{name}_volume"),
            (F.col(f"{p}pnl") / 100.0).alias(f"{name}_pnl"),
        ]
    df = sums.select(*out)
    for name in ("taker", "maker"):
        df = df.withColumn(f"{name}_se", F.sqrt(ratio(F.col(f"{name}_var"), F.col(f"{name}_n")))).withColumn(
            f"{name}_z", F.try_divide(F.col(f"{name}_excess"), F.col(f"{name}_se"))
        )
    return _rounded(df.orderBy(PRICE))


def _by_direction(trades: DataFrame, markets: DataFrame) -> DataFrame:
    rows = _excess(maker_bets(compact(trades), markets).where(F.col(PRICE).between(1, 99)))
    return rows.groupBy(PRICE).agg(*_sums(F.col("side") == "yes", "yes_"), *_sums(F.col("side") == "no", "no_"))


def maker_returns_by_direction(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Makers that bought YES against makers that bought NO, per trade; null where a side has no trade."""
    out = [F.col(PRICE)]
    for p in ("yes_", "no_"):
        out += [
            ratio(F.col(f"{p}wins"), F.col(f"{p}n")).alias(f"{p}win_rate"),
            _mean_excess(p).alias(f"{p}excess"),
            F.when(F.col(f"{p}n") > 0, F.col(f"{p}n")).alias(f"{p}n"),
            F.col(f"{p}contracts"),
            (F.col(f"{p}cents") / 100.0).alias(f"{p}volume")
        ]
    df = _by_direction(trades, markets).select(*out)
    return _rounded(df.withColumn("diff", F.col("no_excess") - F.col("yes_excess")).orderBy(PRICE))


def maker_win_rate_by_direction(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """The same by contracts instead of trades."""
    out = [F.col(PRICE)]
    for p in ("yes_", "no_"):
        rate = ratio(F.col(f"{p}won_contracts"), F.col(f"{p}contracts"))
        out += [
            rate.alias(f"{p}win_rate"),
            (rate - F.col(PRICE) / 100.0).alias(f"{p}mispricing"),
            F.when(F.col(f"{p}n") > 0, F.col(f"{p}n")).alias(f"{p}n"),
            F.col(f"{p}contracts")
        ]
    return _rounded(_by_direction(trades, markets).select(*out, (F.col(PRICE) / 100.0).alias("implied_prob")).orderBy(PRICE))


def _quarter(c: str = "created_time") -> Column:
    return F.date_trunc("quarter", c).cast("timestamp_ntz")


def maker_taker_gap_over_time(trades: DataFrame, markets: DataFrame, least: int = 1000) -> DataFrame:
    """Quarterly excess returns of both roles in percentage points; cells of at least ``least`` trades."""
    rows = _excess(positions(traded(compact(trades.withColumn("quarter", _quarter()), "quarter"), markets), "quarter"))
    sums = rows.groupBy("quarter").agg(*_sums(F.col("role") == "taker", "t_"), *_sums(F.col("role") == "maker", "m_"))
    sums = sums.where(F.col("quarter").isNotNull() & (F.col("t_n") >= least) & (F.col("m_n") >= least))
    t, m = _mean_excess("t_") * 100.0, _mean_excess("m_") * 100.0
    return _rounded(
        sums.select(
            "quarter",
            t.alias("taker_return"),
            m.alias("maker_return"),
            (m - t).alias("gap_pp"),
            F.col("t_n").alias("n_trades"),
            (F.col("t_cents") / 100.0).alias("volume_usd")
        ).orderBy("quarter")
    )


def maker_taker_returns_by_category(trades: DataFrame, markets: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Contract-weighted mean of the categories' excess returns per group, in percentage points."""
    rows = _excess(positions(traded(compact(trades), markets, True, "event_ticker"), "event_ticker"))
    per_event = rows.groupBy("event_ticker").agg(*_sums(F.col("role") == "taker", "t_"), *_sums(F.col("role") == "maker", "m_"))
    keys = [c for c in per_event.columns if c != "event_ticker"]
    cats = per_event.groupBy(category("event_ticker").alias("category")).agg(*(F.sum(c).alias(c) for c in keys))
    cats = cats.withColumn("group", classify(F.col("category"), rules)["group"])
    aggs = []
    for p in ("t_", "m_"):
        aggs += [
            F.sum(_mean_excess(p) * F.col(f"{p}contracts")).alias(f"{p}w"),
            *(F.sum(f"{p}{c}").alias(f"{p}{c}") for c in ("contracts", "n", "cents", "pnl"))
        ]
    groups = cats.groupBy("group").agg(*aggs)
    t, m = 100.0 * ratio(F.col("t_w"), F.col("t_contracts")), 100.0 * ratio(F.col("m_w"), F.col("m_contracts"))
    out = groups.select(
        "group",
        t.alias("taker_excess"),
        m.alias("maker_excess"),
        (m - t).alias("gap"),
        F.col("t_n").alias("taker_n"),
        F.col("m_n").alias("maker_n"),
        (F.col("t_cents") / 100.0).alias("taker_volume"),
        (F.col("m_cents") / 100.0).alias("maker_volume"),
        (F.col("t_pnl") / 100.0).alias("taker_pnl"),
        (F.col("m_pnl") / 100.0).alias("maker_pnl"),
    )
    return _rounded(out.orderBy(F.col("taker_volume").desc_nulls_last(), "group"))


def trade_size_by_role(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Exact quantiles of the trade size in dollars per role.

    Sizes are counted per distinct value first, and the quantiles are taken over values with frequencies,
    so a task holds the distinct sizes, not the trades.
    """
    rows = positions(traded(sized(trades), markets)).withColumn("cents", F.col(COUNT) * F.col(PRICE))
    sizes = rows.groupBy("role", "cents", COUNT).agg(F.sum(ALIKE).alias("f"))
    q = lambda c, p: F.expr(f"percentile({c}, {p}, f)")
    n = F.sum("f")
    total, squares = F.sum(F.col("cents") * F.col("f")), F.sum(
        F.col("cents").cast("decimal(38,0)") * F.col("cents") * F.col("f")
    ).cast("double")
    counted = F.sum(F.when(F.col("cents").isNotNull(), F.col("f")))
    usd = lambda c, name: (c / 100.0).alias(name)
    df = sizes.groupBy("role").agg(
        usd(ratio(total, counted), "mean_trade_size"),
        usd(q("cents", 0.5), "median_trade_size"),
        usd(F.sqrt(variance(squares, total, counted, 0)), "std_trade_size"),
        usd(q("cents", 0.25), "p25_trade_size"),
        usd(q("cents", 0.75), "p75_trade_size"),
        usd(q("cents", 0.9), "p90_trade_size"),
        usd(q("cents", 0.95), "p95_trade_size"),
        ratio(F.sum(F.col(COUNT) * F.col("f")), F.sum(F.when(F.col(COUNT).isNotNull(), F.col("f")))).alias("mean_contracts"),
        q("count", 0.5).alias("median_contracts"),
        n.alias("n_trades"),
        usd(total, "total_volume"),
    )
    return _rounded(df)


def win_rate_by_trade_size(trades: DataFrame, markets: DataFrame, least: int = 10) -> DataFrame:
    """Takers' win rate in quarter-decade bins of the trade size; bins of at least ``least`` trades."""
    rows = traded(sized(trades), markets).select(COUNT, ALIKE, F.col("taker_price").alias(PRICE), F.col("taker_won").alias(WON))
    size = F.col(COUNT) * F.col(PRICE) / 100.0
    rows = _excess(rows).withColumn("bin", F.floor(F.log10(F.greatest(size, F.lit(0.01))) * 4.0)).withColumn(COUNT, F.col(COUNT) * F.col(ALIKE))
    s = rows.groupBy("bin").agg(*_sums(), F.sum(F.col(ALIKE) * F.col(PRICE)).alias("prices")).where(F.col("n") >= least)
    df = s.select(
        F.pow(F.lit(10.0), F.col("bin") / 4.0).alias("trade_size_bin"),
        ratio(F.col("wins"), F.col("n")).alias("win_rate"),
        (ratio(F.col("prices"), F.col("priced")) / 100.0).alias("expected_win_rate"),
        _mean_excess().alias("excess_win_rate"),
        _var_excess(ddof=1).alias("var_excess"),
        F.col("n").alias("n_trades"),
        (F.col("cents") / 100.0).alias("total_volume"),
    )
    return _rounded(_interval(df, "excess_win_rate", F.sqrt(ratio(F.col("var_excess"), F.col("n_trades")))).orderBy("trade_size_bin"))


def _by_hour(trades: DataFrame, markets: DataFrame) -> DataFrame:
    hours = compact(trades.withColumn("hour_et", F.hour("created_time").cast("long")), "hour_et")
    rows = traded(hours, markets).select(COUNT, ALIKE, "hour_et", F.col("taker_price").alias(PRICE), F.col("taker_won").alias(WON))
    p, f = F.col(PRICE), F.col(ALIKE)
    return _excess(rows).groupBy("hour_et").agg(*_sums(), F.sum(f * p).alias("prices"), F.sum(f * p * p).alias("prices2"))


def returns_by_hour(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Takers' excess return by hour of the stored clock."""
    n = F.col("n")
    df = _by_hour(trades, markets).select(
        "hour_et",
        ratio(F.col("wins"), n).alias("win_rate"),
        (ratio(F.col("prices"), F.col("priced")) / 100.0).alias("avg_implied_prob"),
        _mean_excess().alias("excess_return"),
        _var_excess(ddof=1).alias("var_excess"),
        F.col("contracts").alias("total_contracts"), (F.col("cents") / 100.0).alias("total_volume_usd"), n.alias("n_trades"),
    )
    return _rounded(
        _interval(df, "excess_return", F.sqrt(ratio(F.col("var_excess"), F.col("n_trades")))).orderBy(F.col("hour_et").asc_nulls_last())
    )


def vwap_by_hour(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Volume-weighted average taker price by hour of the stored clock; contracts without a price weigh nothing."""
    n = F.col("n")
    df = _by_hour(trades, markets).select(
        "hour_et",
        ratio(F.col("cents"), F.col("priced_contracts")).alias("vwap"),
        F.col("contracts").alias("total_contracts"),
        (F.col("cents") / 100.0).alias("total_volume_usd"),
        n.alias("n_trades"),
        ratio(F.col("prices"), F.col("priced")).alias("avg_price"),
        F.sqrt(variance(F.col("prices2"), F.col("prices"), F.col("priced"), 1)).alias("std_price"),
    )
    return _rounded(
        _interval(df, "vwap", F.col("std_price") / F.sqrt(F.col("n_trades").cast("double"))).orderBy(F.col("hour_et").asc_nulls_last())
    )


def volume_over_time(trades: DataFrame, markets: DataFrame | None = None) -> DataFrame:
    """Contracts per quarter, called dollars."""
    return trades.groupBy(_quarter().alias("quarter")).agg(F.sum(COUNT).alias("volume_usd")).orderBy(F.col("quarter").asc_nulls_last())


def _bucket(p: Column) -> Column:
    out = None
    for a, b in BUCKETS:
        hit, name = p.between(a, b), F.lit(f"{a}-{b}c")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _taker_volume(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Cents, contracts and trades of takers per quarter and price; small after this."""
    rows = traded(
        compact(trades.withColumn("quarter", _quarter()), "quarter"), markets
    ).select("quarter", F.col("taker_price").alias(PRICE), COUNT, ALIKE)
    return rows.groupBy("quarter", PRICE).agg(
        F.sum(F.col(COUNT) * F.col(PRICE)).alias("cents"), F.sum(COUNT).alias("contracts"), F.sum(ALIKE).alias("n_trades")
    )


def longshot_volume_share_over_time(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Quarterly share of the takers' dollars that went into prices of 1 to 20 cents."""
    low = F.col(PRICE).between(1, 20)
    aggs = [F.sum(F.when(low, F.col(c))).alias(c) for c in ("cents", "contracts", "n_trades")]
    df = _taker_volume(trades, markets).where(F.col("quarter").isNotNull()).groupBy("quarter").agg(
        *aggs, F.sum("cents").alias("all_cents")
    ).where(F.col("n_trades") > 0)
    return _rounded(
        df.select(
            "quarter",
            (F.col("cents") / 100.0).alias("volume_usd"),
            "contracts",
            "n_trades",
            (F.col("all_cents") / 100.0).alias("total_volume"),
            (100.0 * ratio(F.col("cents"), F.col("all_cents"))).alias("longshot_share")
        ).orderBy("quarter")
    )


def price_bucket_pivot(trades: DataFrame, markets: DataFrame, least_usd: float = 0.0) -> DataFrame:
    """Quarterly dollars per price bucket, one column each, missing ones 0."""
    names = [f"{a}-{b}c" for a, b in BUCKETS]
    df = _taker_volume(trades, markets).where(
        F.col("quarter").isNotNull() & F.col(PRICE).between(1, 99)
    ).withColumn("bucket", _bucket(F.col(PRICE)))
    wide = df.groupBy("quarter").pivot("bucket", names).agg(F.sum("cents") / 100.0).na.fill(0.0)
    total = sum((F.col(f"`{n}`") for n in names), F.lit(0.0))
    return _rounded(wide.where(total >= least_usd)).orderBy("quarter")


def yes_vs_no_by_price(trades: DataFrame, markets: DataFrame | None = None) -> DataFrame:
    """Contracts of takers and makers on YES and NO at each price, in one aggregation over one scan."""
    yes, no = F.col("taker_side") == "yes", F.col("taker_side") == "no"
    rows = trades.where(yes | no).select(
        F.col(COUNT),
        yes.alias("y"),
        F.explode(
            F.array(
                F.struct(F.col("yes_price").alias("p"), F.lit("yes").alias("s")),
                F.struct(F.col("no_price").alias("p"), F.lit("no").alias("s"))
            )
        ).alias("e")
    )
    rows = rows.select(
        COUNT,
        F.col("e.p").alias(PRICE),
        F.concat(on(F.col("y") == (F.col("e.s") == "yes"), F.lit("taker_"), F.lit("maker_")), F.col("e.s")).alias("who")
    ).where(F.col(PRICE).between(1, 99))
    names = ["taker_yes", "taker_no", "maker_yes", "maker_no"]
    df = rows.groupBy(PRICE).agg(*(F.coalesce(F.sum(F.when(F.col("who") == n, F.col(COUNT))), F.lit(0)).alias(n) for n in names))
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    df = df.withColumn("total", total)
    return _rounded(df.select("*", *((100.0 * ratio(F.col(n), F.col("total"))).alias(f"{n}_pct") for n in names)).orderBy(PRICE))


def ev_yes_vs_no(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Expected value of buying YES or NO at every price 1..99; a price without trades counts -100 for best."""
    rows = compact(trades).join(markets.where(F.col("result").isin("yes", "no")).select("ticker", "result"), "ticker")
    side = lambda s: F.struct(F.lit(s).alias("s"), F.col(f"{s}_price").alias(PRICE))
    rows = rows.select(COUNT, "result", F.explode(F.array(side("yes"), side("no"))).alias("e")).select(
        COUNT, F.col("e.price").alias(PRICE), F.col("e.s").alias("s"), on(F.col("result") == F.col("e.s"), F.col(COUNT)).alias("w")
    )
    sums = rows.where(F.col(PRICE).between(1, 99)).groupBy(PRICE).agg(
        *(F.sum(F.when(F.col("s") == s, F.col(c))).alias(f"{s}_{n}") for s in ("yes", "no") for c, n in ((COUNT, "contracts"), ("w", "w")))
    )
    spine = trades.sparkSession.range(1, 100).select(F.col("id").cast("int").alias(PRICE))
    df = spine.join(sums, PRICE, "left")
    out = [F.col(PRICE)]
    for s in ("yes", "no"):
        rate = ratio(F.col(f"{s}_w"), F.col(f"{s}_contracts"))
        out += [(100.0 * rate - F.col(PRICE)).alias(f"{s}_ev"), rate.alias(f"{s}_win_rate"), F.col(f"{s}_contracts")]
    df = df.select(*out, (F.col(PRICE) / 100.0).alias("implied_prob"))
    y, n = F.coalesce("yes_ev", F.lit(-100.0)), F.coalesce("no_ev", F.lit(-100.0))
    return _rounded(df.withColumn("best_ev", F.greatest(y, n)).withColumn("best_bet", F.when(y > n, "YES").otherwise("NO")).orderBy(PRICE))


def calibration_deviation_over_time(trades: DataFrame, markets: DataFrame, least: int = 1000) -> DataFrame:
    """Mean absolute deviation of cumulative win rates from the price, at each week's end.

    Weeks end on Sundays at the first trade's time of day.  Trades become one row per ticker, prices, side
    and week before they meet the markets (their times one span per ticker and prices); a running sum over
    at most 99 prices per week follows.
    """
    at = F.col("created_time")
    trades = trades.where((F.col("yes_price") > 0) & (F.col("no_price") > 0) & at.isNotNull())
    priced = lambda rows, *keep: positions(traded(rows, markets, False), *keep).where(F.col(PRICE).between(1, 99))
    spans = trades.groupBy("ticker", "yes_price", "no_price", "taker_side").agg(
        F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias(ALIKE), F.sum(COUNT).alias(COUNT)
    )
    span = priced(spans, "lo", "hi").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    first = F.col("lo") + F.make_dt_interval(F.pmod(F.lit(8) - F.dayofweek("lo"), F.lit(7)))
    ends = span.where(F.col("lo").isNotNull() & (first <= F.col("hi"))).select(
        F.explode(F.sequence(first, F.col("hi"), F.expr("interval 7 days"))).alias("date")
    )
    bounds = F.broadcast(span.select(first.alias("first")))
    late = at - F.col("first")
    seconds = F.extract(F.lit("DAY"), late) * 86_400 + F.extract(F.lit("HOUR"), late) * 3_600 + F.extract(
        F.lit("MINUTE"), late
    ) * 60 + F.extract(F.lit("SECOND"), late)
    week = F.greatest(F.ceil(seconds / 604_800), F.lit(0)).cast("int")
    weeks = compact(trades.crossJoin(bounds).withColumn("week", week), "week")  # one bounding row
    weekly = priced(weeks, "week").groupBy("week", PRICE).agg(F.sum(ALIKE).alias("n"), F.sum(F.col(ALIKE) * F.col(WON)).alias("w"))
    numbered = ends.crossJoin(bounds).withColumn(
        "week", (F.extract(F.lit("DAY"), F.col("date") - F.col("first")) / 7).cast("int")
    ).select("date", "week")
    cells = numbered.crossJoin(trades.sparkSession.range(1, 100).select(F.col("id").cast("int").alias(PRICE)))  # weeks x 99 prices
    run = Window.partitionBy(PRICE).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    dense = cells.join(weekly, ["week", PRICE], "left").withColumn(
        "n", F.sum(F.coalesce("n", F.lit(0))).over(run)
    ).withColumn("w", F.sum(F.coalesce("w", F.lit(0))).over(run)).where(F.col("n") > 0)
    gap = F.abs(100.0 * ratio(F.col("w"), F.col("n")) - F.col(PRICE))
    out = dense.groupBy("date").agg(F.avg(gap).alias("mean_absolute_deviation"), F.sum("n").alias("n")).where(F.col("n") >= least)
    return _rounded(out.select("date", "mean_absolute_deviation").orderBy("date"))


def _categories(markets: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    per = markets.groupBy(category("event_ticker").alias("name")).agg(
        F.sum(F.coalesce("volume", F.lit(0))).alias("total_volume"), rows_().alias("market_count")
    )
    return per.withColumn("c", classify(F.col("name"), rules))


def market_types(trades: DataFrame | None, markets: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Volume and number of markets per group."""
    df = _categories(markets, rules).groupBy(F.col("c.group").alias("group")).agg(
        F.sum("total_volume").alias("total_volume"), F.sum("market_count").alias("market_count")
    )
    return df.orderBy(F.col("total_volume").desc_nulls_last(), "group")


def market_type_tree(
    trades: DataFrame | None, markets: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, least_share: float = 0.01
) -> DataFrame:
    """Three levels of volume; a node needs ``least_share`` of its parent's volume."""
    cats = _categories(markets, rules).select("c.*", "total_volume")
    df = cats.rollup("group", "category", "subcategory").agg(F.sum("total_volume").alias("volume"), F.grouping_id().alias("gid"))
    level = on(F.col("gid") == 7, 0, on(F.col("gid") == 3, 1, on(F.col("gid") == 1, 2, 3))).alias("level")
    df = df.select(level, "group", "category", "subcategory", "volume")
    parent = lambda k, keys: df.where(F.col("level") == k).select(*keys, F.col("volume").alias("whole"))
    top = df.where(F.col("level") == 1).crossJoin(F.broadcast(parent(0, [])))  # the single grand total
    mid = df.where(F.col("level") == 2).join(parent(1, ["group"]), "group")
    low = df.where(F.col("level") == 3).join(parent(2, ["group", "category"]), ["group", "category"])
    rows = top.unionByName(mid).unionByName(low)
    return rows.where(F.col("volume") >= F.lit(least_share) * F.col("whole")).select(
        "level", "group", "category", "subcategory", "volume", r6(ratio(F.col("volume"), F.col("whole"))).alias("share")
    )


def category_top_n(trades: DataFrame | None, markets: DataFrame, n: int = 8, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """The ``n`` largest categories of each group, the rest as one row called Other."""
    cats = _categories(markets, rules).select(F.col("c.group").alias("group"), "name", "total_volume")
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.col("total_volume").desc(), "name"))
    return cats.withColumn("k", rank).groupBy(
        "group", on(F.col("k") <= n, F.col("name"), F.lit("Other")).alias("name")
    ).agg(F.sum("total_volume").alias("volume"))


def meta_stats(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Seven figures about the data, plain and formatted."""
    t = trades.agg(rows_().alias("num_trades"), F.sum(COUNT).alias("total_volume"), F.countDistinct("ticker").alias("num_tickers"))
    m = markets.agg(rows_().alias("num_markets"), F.countDistinct("event_ticker").alias("num_events"))
    both = t.crossJoin(m)  # one row each
    whole = lambda name, c: F.struct(
        F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"), F.format_number(c, 0).alias("formatted")
    )
    part = lambda name, c, by, digits: F.struct(
        F.lit(name).alias("metric"),
        (F.col(c) / float(by)).alias("value"),
        F.format_string(f"%.{digits}f", F.col(c) / float(by)).alias("formatted")
    )
    rows = F.array(
        whole("num_trades", "num_trades"),
        part("num_trades_millions", "num_trades", 10**6, 1),
        whole("total_volume", "total_volume"),
        part("total_volume_billions", "total_volume", 10**9, 2),
        whole("num_markets", "num_markets"), whole("num_events", "num_events"), whole("num_tickers_from_trades", "num_tickers"),
    )
    return _rounded(both.select(F.explode(rows).alias("r")).select("r.*"))
