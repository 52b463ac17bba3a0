"""All queries of the core by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.operators.lineage import cut
from augury.plans import operators, operators_sql, statistics, stored, stored_sql, training, training_sql, venue_k, venue_k_sql, venue_p, venue_p_sql, views
from augury.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Query name to analysis of the order-book venue.
VENUE_K = {
    "win_rate_by_price": venue_k.win_rate_by_price,
    "mispricing_by_price": venue_k.mispricing_by_price,
    "maker_vs_taker_returns": venue_k.maker_vs_taker_returns,
    "maker_returns_by_direction": venue_k.maker_returns_by_direction,
    "maker_win_rate_by_direction": venue_k.maker_win_rate_by_direction,
    "maker_taker_gap_quarterly": venue_k.maker_taker_gap_over_time,
    "returns_by_category": venue_k.maker_taker_returns_by_category,
    "trade_size_by_role": venue_k.trade_size_by_role,
    "win_rate_by_trade_size": venue_k.win_rate_by_trade_size,
    "returns_by_hour": venue_k.returns_by_hour,
    "vwap_by_hour": venue_k.vwap_by_hour,
    "volume_over_time": venue_k.volume_over_time,
    "longshot_volume_share": venue_k.longshot_volume_share_over_time,
    "price_bucket_pivot": venue_k.price_bucket_pivot,
    "yes_vs_no_by_price": venue_k.yes_vs_no_by_price,
    "ev_yes_vs_no": venue_k.ev_yes_vs_no,
    "calibration_deviation_weekly": venue_k.calibration_deviation_over_time,
    "market_types": venue_k.market_types,
    "market_types_rollup": venue_k.market_type_tree,
    "category_top_n_other": venue_k.category_top_n,
    "meta_stats": venue_k.meta_stats,
    "mann_whitney_u": statistics.mann_whitney_by_price,
    "two_proportion_z": statistics.two_proportion_z,
    "two_proportion_z_small": lambda t, m: statistics.two_proportion_z(t, m, least=10),
    "welch_and_cohens_d": statistics.welch_by_group,
    "pearson_spearman": statistics.size_correlations,
    "wls_binned_regression": statistics.binned_regression,
    "maker_direction_test": statistics.maker_direction_test,
    "statistical_tests": statistics.statistical_tests,
    "p_values": lambda t, m: statistics.maker_taker_p_values(venue_k.maker_vs_taker_returns(t, m)).withColumns(
        {c: F.round(c, 9) for c in ("taker_p", "maker_p")}
    ),
}

#: Analyses that look at no price of a trade.
UNPRICED = {"volume_over_time", "market_types", "market_types_rollup", "category_top_n_other", "meta_stats"}


def _on_venue_k(analysis: Callable[[DataFrame, DataFrame], DataFrame], trades: Query = views.k_trades) -> Query:
    return lambda spark, d: analysis(trades(spark, d), views.k_markets(spark, d))


def _venue_p() -> dict[str, Query]:
    t = lambda name: lambda s, d: table(s, d, name)
    trades, blocks, collateral = views.p_fills, t("p_blocks"), t("p_collateral")
    four = lambda s, d: (views.p_fills(s, d), views.p_markets(s, d), views.p_amm(s, d), collateral(s, d))
    days = lambda s, d: (  # noqa: E731  # at most 99 prices a day: computed once, however often a plan looks at them
        cut(venue_p.daily_k(views.k_trades(s, d), views.k_markets(s, d))), cut(venue_p.daily_p(*four(s, d)[:3], blocks(s, d), collateral(s, d)))
    )
    return {
        "polymarket_win_rate_by_price": lambda s, d: venue_p.win_rate_by_price(*four(s, d)),
        "calibration_metrics": lambda s, d: venue_p.calibration_metrics(venue_p.win_rate_by_price(*four(s, d))),
        "polymarket_calibration_by_bucket": lambda s, d: venue_p.calibration_by_bucket(*four(s, d)),
        "bucket_metrics": lambda s, d: venue_p.bucket_metrics(venue_p.calibration_by_bucket(*four(s, d))),
        "polymarket_trades_over_time": lambda s, d: venue_p.trades_over_time(trades(s, d), views.p_legacy(s, d), blocks(s, d)),
        "polymarket_volume_over_time": lambda s, d: venue_p.volume_over_time(
            trades(s, d), views.p_legacy(s, d), blocks(s, d), collateral(s, d)
        ),
        "daily_cumulative_snapshot": lambda s, d: venue_p.snapshots(*days(s, d)).drop("day_total").withColumn(
            "day", F.date_format("day", "yyyy-MM-dd")
        ),
        "every_other_day": lambda s, d: venue_p.kept_days(venue_p.snapshots(*days(s, d))).withColumn(
            "day", F.date_format("day", "yyyy-MM-dd")
        ),
        "animation_frames": lambda s, d: venue_p.animation_frames(*days(s, d)),
        "win_rate_by_price_animated": lambda s, d: venue_p.win_rate_by_price_animated(*days(s, d)),
    }


def queries() -> dict[str, Query]:
    found = {n: f for n, f in vars(training).items() if n[0] == "p" and n[1:2].isdigit()}
    single = {
        n: f for m in (operators, stored) for n, f in vars(m).items() if getattr(f, "__module__", "") == m.__name__ and not n.startswith("_")
    }
    return found | {
        n: _on_venue_k(f, views.k_contracts if n in UNPRICED else views.k_trades) for n, f in VENUE_K.items()
    } | _venue_p() | single


def oracle_sql() -> dict[str, str]:
    return training_sql.SQL | venue_k_sql.SQL | venue_p_sql.SQL | operators_sql.SQL | stored_sql.SQL
