"""Analyses over stored tables look at every row."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from augury.plans import venue_k, views
from augury.plans.registry import queries

TRADE = "trade_id string, ticker string, count bigint, yes_price int, no_price int, taker_side string, created_time timestamp_ntz, feed string, price_note string, _fetched_at timestamp_ntz"
#: Trades of every unit: (count, yes, no, feed, note), and the two prices in whole cents.
TRADES = [
    ((10, 40, 60, "rest", None), (40, 60)),
    ((20, 400, 600, "archive", None), (40, 60)),
    ((30, 4000, 6000, "fp", None), (40, 60)),
    ((40, 400_000, 600_000, None, "in microusd"), (40, 60)),
    ((50, 455, 545, "archive", None), (46, 55)),
    ((60, 4049, 5950, "fp", None), (40, 60)),
    ((70, 40, 59, "rest", None), (40, 59)),
    ((80, 40, None, "rest", None), (40, None)),
    ((90, None, 60, "rest", None), (None, 60)),
]


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    out = tmp_path_factory.mktemp("whole")
    rows = [(str(k), "mkt-a ", c, y, n, "yes", None, feed, note, None) for k, ((c, y, n, feed, note), _) in enumerate(TRADES)]
    spark.createDataFrame(rows, TRADE).coalesce(1).write.parquet(f"{out}/k_trades.parquet")
    spark.read.parquet(f"{small}/unit_defs.parquet").write.parquet(f"{out}/unit_defs.parquet")
    return str(out)


def test_every_trade_in_cents(spark, folder):
    got = {r["count"]: (r["yes_price"], r["no_price"]) for r in views.k_trades(spark, folder).collect()}
    assert got == {t[0]: cents for t, cents in TRADES}


def test_stream_counts_every_trade(spark, folder):
    got = {r["price"]: (r["n"], r["contracts"]) for r in queries()["stream_equals_batch"](spark, folder).collect()}
    assert got == {40: (7, 310), 46: (1, 50), None: (1, 90)}


def test_unpriced_trades_have_no_excess(spark, folder, k_markets):
    [r] = venue_k.returns_by_hour(views.k_trades(spark, folder).where(F.col("count").isin(10, 90)), k_markets).collect()
    assert (r["n_trades"], r["total_contracts"], r["avg_implied_prob"], r["excess_return"]) == (2, 100, 0.4, 0.6)
    [v] = venue_k.vwap_by_hour(views.k_trades(spark, folder).where(F.col("count").isin(10, 90)), k_markets).collect()
    assert (v["vwap"], v["avg_price"], v["total_contracts"]) == (40.0, 40.0, 100)


def test_volumes_are_whole(spark, small):
    """Every stored trade counts, once: copies of an identifier are one trade, trades without one are all different."""
    key = "nullif(lower(trim(trade_id, ' ' || chr(9))), '')"
    rest = "count, created_time, feed, no_price, price_note, taker_side, ticker, trade_id, yes_price"
    once = f"SELECT * FROM '{small}/k_trades.parquet' QUALIFY {key} IS NULL OR row_number() OVER (PARTITION BY {key} ORDER BY _fetched_at, {rest}) = 1"
    [(n, contracts, dated)] = duckdb.sql(f"SELECT count(*), sum(count), sum(count) FILTER (created_time IS NOT NULL) FROM ({once})").fetchall()
    [(stored, delivered)] = duckdb.sql(f"SELECT count(*), sum(count) FROM '{small}/k_trades.parquet'").fetchall()
    assert n < stored
    got = {r["metric"]: r["value"] for r in queries()["meta_stats"](spark, small).collect()}
    assert (got["num_trades"], got["total_volume"]) == (n, contracts)
    total = lambda name, c: queries()[name](spark, small).agg(F.sum(c)).first()[0]
    assert total("volume_over_time", "volume_usd") == contracts and total("quarter_labels", "contracts") == dated
    assert (total("stream_equals_batch", "n"), total("stream_equals_batch", "contracts")) == (stored, delivered)


def test_fills_and_amm_trades_in_millionths(spark, small, tmp_path):
    fills = [("CTF Exchange", 400_000), ("NegRisk Sandbox", 40), ("CTF Exchange v0", 400_000_000)]
    spark.createDataFrame(
        [(k, "0", "t", a, 1_000_000, None, c, f"0x{k}", 0, None) for k, (c, a) in enumerate(fills)],
        "block_number long, maker_asset_id string, taker_asset_id string, maker_amount long, taker_amount long, amount_note string, "
        "_contract string, transaction_hash string, log_index long, _fetched_at timestamp_ntz"
    ).write.parquet(f"{tmp_path}/p_trades.parquet")
    tokens = ["1000000000000000000", "0xde0b6b3a7640000", "1e18", "1.0", "1,000 [milli]", "micro: 1 000 000", "shares: 1", "junk"]
    spark.createDataFrame(
        [(k, "0xA", "400000", 0, t) for k, t in enumerate(tokens)],
        "block_number long, fpmm_address string, amount string, outcome_index long, outcome_tokens string"
    ).write.parquet(f"{tmp_path}/p_legacy.parquet")
    spark.read.parquet(f"{small}/unit_defs.parquet").write.parquet(f"{tmp_path}/unit_defs.parquet")
    assert [r[0] for r in views.p_fills(spark, str(tmp_path)).orderBy("block_number").select("maker_amount").collect()] == [400_000.0] * 3
    got = [r[0] for r in views.p_amm(spark, str(tmp_path)).orderBy("block_number").select("outcome_tokens").collect()]
    assert got == [1_000_000.0] * 7 + [None]


def test_amm_trades_reach_the_price_gate(spark, small):
    rows = views.p_amm(spark, small).where(F.expr("100 * try_cast(amount AS DOUBLE) / outcome_tokens BETWEEN 1 AND 99"))
    assert rows.count() > 0.9 * views.p_amm(spark, small).where("outcome_tokens > 0").count()


def test_admitted_knows_trades_without_a_fetch_time(spark, tmp_path):
    day = datetime(2024, 2, 1)
    rows = [("a", 1, None), ("a", 2, day), ("b", 3, day)]
    spark.createDataFrame(rows, "trade_id string, count bigint, _fetched_at timestamp_ntz").write.parquet(f"{tmp_path}/k_trades.parquet")
    assert [r["msg_key"] for r in queries()["p5_admitted"](spark, str(tmp_path)).collect()] == ["b"]
