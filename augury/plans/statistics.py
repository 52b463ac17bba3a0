"""Statistical tests on trades, from exact counts and moments.

Ranks are taken over distinct values with frequencies, so nothing is sampled and no task sees all trades.
Trades alike in ticker, prices, side and size are one row with their number before they meet the markets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions.classify import DEFAULT_RULES, Rule, category, classify
from augury.functions.distributions import two_sided_normal_p, two_sided_t_p, upper_normal_p
from augury.functions.numbers import r6, ratio, variance
from augury.operators.lineage import cut
from augury.plans.views import ALIKE, maker_bets, sized, traded

# Prices and price ranges of the tests, and the least number of trades per cell.
TEST_PRICES = (1, 2, 3, 4, 5, 10, 15, 20, 25, 50, 75, 80, 85, 90, 95, 96, 97, 98, 99)
PRICE_RANGES = ((1, 10), (11, 25), (26, 50), (51, 75), (76, 90), (91, 99))
LEAST = 100


def equal_width_bin(x: Column, lo: Column, hi: Column, k: int) -> Column:
    """The bin 1..k of ``x`` in equal widths from ``lo`` to ``hi``, closed on the right."""
    return F.when(
        hi > lo, F.least(F.greatest(F.ceil((x - lo) / ((hi - lo) / F.lit(float(k)))), F.lit(1)), F.lit(k))
    ).otherwise((k + 1) // 2).cast("int")


def with_bin(df: DataFrame, x: str, k: int, name: str) -> DataFrame:
    """Adds :func:`equal_width_bin` over the range of a column; the range is one row."""
    span = df.agg(F.min(x).cast("double").alias("__lo"), F.max(x).cast("double").alias("__hi"))
    return df.crossJoin(F.broadcast(span)).withColumn(
        name, equal_width_bin(F.col(x).cast("double"), F.col("__lo"), F.col("__hi"), k)
    ).drop("__lo", "__hi")


def tie_ranks(values: DataFrame, value: str, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., value, rank, ties)``: tie-averaged ranks of distinct positive values with frequencies.

    Values are cut into log-scale slices; ranks run within a slice on top of the totals of lower slices,
    so the largest task holds one slice.
    """
    counts = values.groupBy(*by, value).agg(F.sum(weight).alias("ties"))
    counts = counts.withColumn("__slice", F.floor(F.log2(F.greatest(F.col(value).cast("double"), F.lit(0.0)) + 1.0) * 16.0))
    slices = counts.groupBy(*by, "__slice").agg(F.sum("ties").alias("s"))
    below = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(*by, "__slice", F.coalesce(F.sum("s").over(below), F.lit(0)).alias("__below"))
    run = Window.partitionBy(*by, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(offsets, [*by, "__slice"]).withColumn("__upto", F.sum("ties").over(run) + F.col("__below"))
    return ranked.select(*by, value, (F.col("__upto") - (F.col("ties") - 1) / 2.0).alias("rank"), "ties")


def mann_whitney_by_price(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Are makers' sizes larger than takers'?  Per tenth of the observed range of prices, at least 100 trades."""
    rows = traded(sized(trades), markets).where(
        F.col("taker_price").isNotNull() & F.col("maker_price").isNotNull() & F.col("count").isNotNull()
    )
    cells = rows.groupBy(
        F.col("taker_price").alias("price"),
        (F.col("count") * F.col("taker_price")).alias("t"),
        (F.col("count") * F.col("maker_price")).alias("m")
    ).agg(F.sum(ALIKE).alias("f"))
    cells = with_bin(cells, "price", 10, "price_bin")
    sides = cells.select(
        "price_bin",
        "f",
        F.explode(
            F.array(F.struct(F.lit(0).alias("g"), F.col("t").alias("v")), F.struct(F.lit(1).alias("g"), F.col("m").alias("v")))
        ).alias("e")
    ).select("price_bin", "f", "e.g", "e.v")
    values = sides.groupBy("price_bin", "v").agg(F.sum(F.when(F.col("g") == 1, F.col("f")).otherwise(0)).alias("mk"), F.sum("f").alias("f"))
    ranks = tie_ranks(values, "v", "f", ("price_bin",))
    joined = values.select("price_bin", "v", "mk").join(ranks, ["price_bin", "v"])
    u = joined.groupBy("price_bin").agg(
        F.sum(F.col("mk") * F.col("rank")).alias("r1"),
        F.sum("mk").alias("n"),
        F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")).alias("tie")
    )
    means = cells.groupBy("price_bin").agg(
        F.sum(F.col("t") * F.col("f")).alias("t"),
        F.sum(F.col("m") * F.col("f")).alias("m"),
        F.expr("percentile(t, 0.5, f)").alias("t_median"),
        F.expr("percentile(m, 0.5, f)").alias("m_median"),
    )
    n = F.col("n").cast("double")
    df = u.join(means, "price_bin").where(F.col("n") >= LEAST).withColumn("u_statistic", F.col("r1") - n * (n + 1.0) / 2.0)
    total = 2.0 * n
    spread = F.sqrt(n * n / 12.0 * ((total + 1.0) - F.col("tie") / (total * (total - 1.0))))
    z = F.try_divide(F.col("u_statistic") - n * n / 2.0 - 0.5, spread)
    label = F.concat(((F.col("price_bin") - 1) * 10 + 1).cast("string"), F.lit("-"), (F.col("price_bin") * 10).cast("string"), F.lit("c"))
    return df.select(
        label.alias("price_bin"),
        r6(F.col("t") / n / 100.0).alias("taker_mean"),
        r6(F.col("m") / n / 100.0).alias("maker_mean"),
        r6(F.col("t_median") / 100.0).alias("taker_median"),
        r6(F.col("m_median") / 100.0).alias("maker_median"),
        r6(ratio(F.col("m"), F.col("t"))).alias("ratio"),
        F.col("u_statistic"),
        r6(z).alias("z"),
        r6(1.0 - 2.0 * F.col("u_statistic") / (n * n)).alias("effect_size_r"),
        F.col("n").alias("n_trades"),
        (F.col("m") > F.col("t")).alias("maker_larger"),
    )


def two_proportion_z(trades: DataFrame, markets: DataFrame, least: int = LEAST) -> DataFrame:
    """YES against NO takers at fixed prices, by contracts; at least ``least`` trades on each side."""
    rows = traded(sized(trades), markets).where(F.col("taker_side").isin("yes", "no") & F.col("taker_price").isin(*TEST_PRICES))
    aggs = []
    for s in ("yes", "no"):
        side = F.col("taker_side") == s
        aggs += [
            F.sum(F.when(side, F.col(ALIKE))).alias(f"{s}_t"),
            F.sum(F.when(side, F.col(ALIKE) * F.col("count"))).alias(f"{s}_n"),
            F.sum(F.when(side, F.col(ALIKE) * F.col("count") * F.col("taker_won"))).alias(f"{s}_w")
        ]
    df = rows.groupBy(F.col("taker_price").alias("price")).agg(*aggs).where((F.col("yes_t") >= least) & (F.col("no_t") >= least))
    y, n, pooled = ratio(F.col("yes_w"), F.col("yes_n")), ratio(F.col("no_w"), F.col("no_n")), ratio(
        F.col("yes_w") + F.col("no_w"), F.col("yes_n") + F.col("no_n")
    )
    se = F.sqrt(pooled * (1.0 - pooled) * (F.try_divide(F.lit(1.0), F.col("yes_n")) + F.try_divide(F.lit(1.0), F.col("no_n"))))
    ev = lambda r: (r * 100.0 - F.col("price")) / F.col("price") * 100.0
    return df.select(
        "price",
        r6(y).alias("yes_win_rate"),
        r6(n).alias("no_win_rate"),
        r6((n - y) * 100.0).alias("diff_pp"),
        r6(ev(y)).alias("yes_ev"),
        r6(ev(n)).alias("no_ev"),
        r6(ev(n) - ev(y)).alias("ev_diff"),
        r6(F.when(se > 0, (n - y) / se).otherwise(0.0)).alias("z_statistic"), "yes_n", "no_n", (n > y).alias("no_better"),
    )


def _welch(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds t, its degrees of freedom and Cohen's d from ``<p>n, <p>x, <p>xx`` (excess in cents) of two samples."""
    n = {p: F.col(f"{p}n").cast("double") for p in (a, b)}
    mean = {p: ratio(F.col(f"{p}x"), F.col(f"{p}n")) / 100.0 for p in (a, b)}
    var = {p: variance(F.col(f"{p}xx"), F.col(f"{p}x"), F.col(f"{p}n"), 1) / 10_000.0 for p in (a, b)}
    part = {p: var[p] / n[p] for p in (a, b)}
    whole = part[a] + part[b]
    df = df.withColumn("t_statistic", F.try_divide(mean[a] - mean[b], F.sqrt(whole)))
    df = df.withColumn("df", F.try_divide(whole * whole, part[a] * part[a] / (n[a] - 1.0) + part[b] * part[b] / (n[b] - 1.0)))
    pooled = F.sqrt(((n[a] - 1.0) * var[a] + (n[b] - 1.0) * var[b]) / (n[a] + n[b] - 2.0))
    return df.withColumn("cohens_d", F.when(pooled > 0, (mean[a] - mean[b]) / pooled).otherwise(0.0))


def welch_by_group(trades: DataFrame, markets: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, base: str = "Finance") -> DataFrame:
    """Takers' excess return of one group against each other group with at least 100 trades."""
    x = F.col("taker_won") * 100 - F.col("taker_price")
    f = F.col(ALIKE)
    cats = traded(sized(trades), markets, True, "event_ticker").groupBy(category("event_ticker").alias("name")).agg(
        F.coalesce(F.sum(F.when(x.isNotNull(), f)), F.lit(0)).alias("n"), F.sum(f * x).alias("x"), F.sum(f * x * x).alias("xx")
    )
    groups = cats.withColumn(
        "group", classify(F.col("name"), rules)["group"]
    ).groupBy("group").agg(*(F.sum(c).alias(c) for c in ("n", "x", "xx")))
    one = groups.where(F.col("group") == base).select(*(F.col(c).alias(f"a_{c}") for c in ("n", "x", "xx")))
    other = groups.where((F.col("group") != base) & (F.col("n") >= LEAST)).select(
        "group", *(F.col(c).alias(f"b_{c}") for c in ("n", "x", "xx"))
    )
    df = _welch(other.crossJoin(F.broadcast(one)), "a_", "b_")  # one row beside a row per group
    a, b = ratio(F.col("a_x"), F.col("a_n")), ratio(F.col("b_x"), F.col("b_n"))
    return df.select(
        F.concat(F.lit(f"{base} vs "), F.col("group")).alias("comparison"),
        r6(a).alias("finance_mean"),
        r6(b).alias("other_mean"),
        r6(a - b).alias("diff_pp"),
        r6("t_statistic").alias("t_statistic"),
        r6("df").alias("df"), r6("cohens_d").alias("cohens_d"), F.col("a_n").alias("finance_n"), F.col("b_n").alias("other_n"),
    )


def _size_cells(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """``(cents, x, f)``: taker's size and excess (both in cents) with frequencies."""
    rows = traded(sized(trades), markets).where(F.col("count").isNotNull() & F.col("taker_price").isNotNull())
    return rows.groupBy(
        (F.col("count") * F.col("taker_price")).alias("cents"), (F.col("taker_won") * 100 - F.col("taker_price")).alias("x")
    ).agg(F.sum(ALIKE).alias("f"))


def _log_size() -> Column:
    return F.log10(F.greatest(F.col("cents") / 100.0, F.lit(0.01)))


def _weighted_corr(a: Column, b: Column, f: Column) -> Column:
    n, sa, sb = F.sum(f), F.sum(a * f), F.sum(b * f)
    cov = F.sum(a * b * f) - sa * sb / n
    return F.try_divide(cov, F.sqrt((F.sum(a * a * f) - sa * sa / n) * (F.sum(b * b * f) - sb * sb / n)))


def size_correlations(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Pearson's r and Spearman's rho of log size and excess return over all trades; one row.

    Sizes up to a cent share one value on the log scale, so they share one rank.
    """
    cells = _size_cells(trades, markets).withColumn("cents", F.greatest("cents", F.lit(1))).groupBy("cents", "x").agg(F.sum("f").alias("f"))
    by_size = tie_ranks(cells, "cents", "f").select("cents", F.col("rank").alias("ra"))
    by_excess = tie_ranks(
        cells.select((F.col("x") + 101).alias("y"), "f"), "y", "f"
    ).select((F.col("y") - 101).alias("x"), F.col("rank").alias("rb"))
    df = cells.join(by_size, "cents").join(by_excess, "x")
    f = F.col("f").cast("double")
    return df.agg(
        r6(_weighted_corr(_log_size(), F.col("x") / 100.0, f)).alias("pearson_r"),
        r6(_weighted_corr(F.col("ra"), F.col("rb"), f)).alias("spearman_r"),
        F.sum("f").alias("n")
    )


def binned_regression(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Line through the means of 20 bins of log size, weighted by trades; R² weighted by their root; one row."""
    cells = with_bin(_size_cells(trades, markets).withColumn("l", _log_size()), "l", 20, "bin")
    f = F.col("f").cast("double")
    bins = cells.groupBy("bin").agg(
        F.sum(f).alias("n"), (F.sum(F.col("x") * f) / F.sum(f) / 100.0).alias("y"), (F.sum(F.col("l") * f) / F.sum(f)).alias("x")
    )
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    s = bins.agg(
        F.sum(n).alias("s"),
        F.sum(n * x).alias("sx"),
        F.sum(n * y).alias("sy"),
        F.sum(n * x * x).alias("sxx"),
        F.sum(n * x * y).alias("sxy"),
        (F.sum(F.sqrt(n) * y) / F.sum(F.sqrt(n))).alias("ym")
    )
    slope = F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"))
    s = s.withColumn("slope", slope).withColumn(
        "icept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("s")
    ).select("slope", "icept", "ym")
    df = bins.crossJoin(F.broadcast(s))  # one row beside at most 20
    miss, whole = y - (F.col("slope") * x + F.col("icept")), y - F.col("ym")
    return df.agg(
        r6(F.max("slope") * 100.0).alias("slope_pp_per_log10"),
        r6(1.0 - F.try_divide(F.sum(F.sqrt(n) * miss * miss), F.sum(F.sqrt(n) * whole * whole))).alias("r_squared")
    )


def maker_direction_test(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Makers on NO against makers on YES in six price ranges.

    The test counts each trade by its contracts, at most 100, as moments instead of repeated rows; it
    samples nothing.
    """
    low = None
    for a, b in PRICE_RANGES:
        hit = F.col("price").between(a, b)
        low = F.when(hit, a) if low is None else low.when(hit, a)
    names = F.create_map(*(F.lit(x) for a, b in PRICE_RANGES for x in (a, f"{a}-{b}c")))
    f, x, w = F.col(ALIKE), F.col("won") * 100 - F.col("price"), F.least(F.col("count"), F.lit(100))
    aggs = []
    for s in ("yes", "no"):
        pick = lambda c, s=s: F.sum(F.when(F.col("side") == s, c))
        aggs += [
            pick(f).alias(f"{s}_t"),
            pick(f * F.col("count")).alias(f"{s}_c"),
            pick(f * F.col("count") * x).alias(f"{s}_cx"),
            pick(f * w).alias(f"{s}_n"),
            pick(f * w * x).alias(f"{s}_x"),
            pick(f * w * x * x).alias(f"{s}_xx")
        ]
    df = maker_bets(sized(trades), markets).withColumn("low", low).where(F.col("low").isNotNull()).groupBy("low").agg(*aggs).where(
        (F.col("yes_t") >= LEAST) & (F.col("no_t") >= LEAST)
    )
    y, n = ratio(F.col("yes_cx"), F.col("yes_c")), ratio(F.col("no_cx"), F.col("no_c"))
    return _welch(df, "no_", "yes_").select(
        names[F.col("low")].alias("price_range"),
        r6(y).alias("yes_excess_pp"),
        r6(n).alias("no_excess_pp"),
        r6(n - y).alias("diff_pp"),
        r6("t_statistic").alias("t_statistic"),
        r6("df").alias("df"),
        r6("cohens_d").alias("cohens_d"),
        F.col("yes_t").alias("yes_n"), F.col("no_t").alias("no_n"), (n > y).alias("no_better"),
    )


def maker_taker_p_values(returns: DataFrame) -> DataFrame:
    """Adds two-sided p-values to the table of ``maker_vs_taker_returns``."""
    return returns.withColumn("taker_p", two_sided_normal_p(F.col("taker_z"))).withColumn("maker_p", two_sided_normal_p(F.col("maker_z")))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation by Student's t."""
    df = n.cast("double") - 2.0
    return two_sided_t_p(r * F.sqrt(F.try_divide(df, 1.0 - r * r)), df)


def statistical_tests(trades: DataFrame, markets: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Summary ``(test, metric, value)`` of the five tests, 20 rows; a test without data has zeros and nulls.

    All tests read one table of trades alike, kept in the shared folder, and no trade again.
    """
    trades, markets = cut(sized(trades)), cut(markets.select("ticker", "status", "result", "event_ticker"))

    def part(df: DataFrame, test: str, **metrics: Column) -> DataFrame:
        row = df.agg(
            *(
                F.coalesce(c, F.lit(0)).cast("double").alias(m) if m.split("_")[0] in (
                    "bins", "prices", "ranges", "all", "total"
                ) else c.cast("double").alias(m) for m, c in metrics.items()
            )
        )
        return row.select(
            F.lit(test).alias("test"),
            F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("r")
        ).select("test", "r.metric", r6("r.value").alias("value"))

    significant = F.count_if(F.col("p") < 0.05)
    sizes = mann_whitney_by_price(trades, markets).withColumn("p", upper_normal_p(F.col("z")))
    sides = two_proportion_z(trades, markets).withColumn("p", two_sided_normal_p(F.col("z_statistic")))
    groups = welch_by_group(trades, markets, rules).withColumn("p", two_sided_t_p(F.col("t_statistic"), F.col("df")))
    ranges = maker_direction_test(trades, markets).withColumn("p", two_sided_t_p(F.col("t_statistic"), F.col("df")))
    both = size_correlations(trades, markets).crossJoin(binned_regression(trades, markets))  # one row each
    both = both.withColumn("pearson_p", correlation_p(F.col("pearson_r"), F.col("n"))).withColumn(
        "spearman_p", correlation_p(F.col("spearman_r"), F.col("n"))
    )
    return (
        part(
            sizes,
            "trade_size_consistency",
            bins_maker_larger=F.count_if("maker_larger"),
            bins_total=F.count("*"),
            bins_significant_p05=significant,
            overall_ratio=F.avg("ratio")
        )
        .unionByName(
            part(
                sides,
                "yes_no_asymmetry",
                prices_no_better=F.count_if("no_better"),
                prices_total=F.count("*"),
                prices_significant=significant,
                avg_ev_diff=F.avg("ev_diff")
            )
        )
        .unionByName(
            part(
                groups,
                "category_comparisons",
                all_significant_vs_finance=significant,
                total_comparisons=F.count("*"),
                max_cohens_d=F.max(F.abs("cohens_d"))
            )
        )
        .unionByName(
            part(
                both,
                "trade_size_regression",
                **{m: F.max(m) for m in ("pearson_r", "pearson_p", "spearman_r", "spearman_p", "slope_pp_per_log10", "r_squared")}
            )
        )
        .unionByName(
            part(
                ranges,
                "maker_direction",
                ranges_no_better=F.count_if("no_better"),
                ranges_total=F.count("*"),
                ranges_significant=significant
            )
        )
    )
