"""Analyses on hand-made relations with values derived by hand."""

from __future__ import annotations

import pytest

from augury.plans import venue_k, venue_p


def table(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_meta_stats(k_trades, k_markets):
    got = {r["metric"]: r["value"] for r in venue_k.meta_stats(k_trades, k_markets).collect()}
    assert (
        got["num_trades"], got["total_volume"], got["num_tickers_from_trades"], got["num_markets"], got["num_events"]
    ) == (2100, 12_600, 2, 2, 2)


def test_volume(k_trades):
    [row] = venue_k.volume_over_time(k_trades).collect()
    assert (str(row["quarter"]), row["volume_usd"]) == ("2024-04-01 00:00:00", 12_600)


def test_win_rate_by_price(k_trades, k_markets):
    got = {p: (r["total_trades"], r["wins"]) for p, r in table(venue_k.win_rate_by_price(k_trades, k_markets), "price").items()}
    assert got == {
        **dict.fromkeys((10, 30, 50, 70, 90), (600, 300)), **dict.fromkeys((20, 60), (300, 200)), **dict.fromkeys((40, 80), (300, 100))
    }


def test_expected_value(k_trades, k_markets):
    got = table(venue_k.ev_yes_vs_no(k_trades, k_markets), "price")
    assert len(got) == 99
    rate = lambda p, s: (got[p][f"{s}_contracts"], got[p][f"{s}_win_rate"])
    assert rate(10, "yes") == (
        1800, pytest.approx(1000 / 1800, abs=1e-6)
    ) and rate(20, "yes") == (1300, pytest.approx(1000 / 1300, abs=1e-6)) and rate(40, "yes") == (500, 0)
    assert rate(10, "no") == (
        1800, pytest.approx(800 / 1800, abs=1e-6)
    ) and rate(20, "no") == (500, 1) and rate(40, "no") == (1300, pytest.approx(300 / 1300, abs=1e-6))
    assert got[1]["best_ev"] == -100 and got[1]["best_bet"] == "NO" and got[1]["yes_ev"] is None


def test_makers_by_direction(k_trades, k_markets):
    got = table(venue_k.maker_returns_by_direction(k_trades, k_markets), "price")
    assert set(got) == {10, 30, 40, 50, 70, 80, 90}
    for r in got.values():
        assert (r["yes_n"], r["yes_contracts"], r["yes_win_rate"]) == (100, 500, 0)
        assert (r["no_n"], r["no_contracts"], r["no_win_rate"]) == (200, 1300, 0.5)


def test_one_sided_price(k_trades, k_markets):
    got = table(venue_k.maker_returns_by_direction(k_trades.where("taker_side = 'no'"), k_markets), "price")
    assert all(r["no_n"] is None and r["no_win_rate"] is None and r["diff"] is None for r in got.values())


def test_trade_size(k_trades, k_markets):
    got = table(venue_k.trade_size_by_role(k_trades, k_markets), "role")
    assert got["taker"]["mean_trade_size"] == pytest.approx(2.828571, abs=1e-5) and got["taker"]["median_trade_size"] == pytest.approx(2.1)
    assert got["maker"]["mean_trade_size"] == pytest.approx(3.171428, abs=1e-5) and got["maker"]["median_trade_size"] == pytest.approx(2.5)


def test_venue_p(p_tables):
    t = p_tables
    args = t["trades"], t["markets"], t["legacy"], t["collateral"]
    by_price = venue_p.win_rate_by_price(*args)
    assert {
        r["price"]: (r["total_trades"], r["wins"], r["win_rate"]) for r in by_price.collect()
    } == dict.fromkeys((20.0, 40.0, 50.0, 60.0, 80.0), (8, 4, 50.0))
    m = venue_p.calibration_metrics(by_price).first()
    assert (m["brier_score"], m["ece"], m["total_trades"]) == (0.29, 0.16, 40)
    b = venue_p.bucket_metrics(venue_p.calibration_by_bucket(*args)).first()
    assert (b["ece"], b["mce"], b["num_buckets"]) == (16.0, 30.0, 5)
    assert [
        (r["block_number"], r["trade_count"]) for r in venue_p.trades_over_time(t["trades"], t["legacy"], t["blocks"]).collect()
    ] == [(b, 1) for b in [*range(100, 110), *range(200, 210)]]
    [v] = venue_p.volume_over_time(t["trades"], t["legacy"], t["blocks"], t["collateral"]).collect()
    assert (str(v["quarter"]), v["volume_usd"]) == ("2024-04-01 00:00:00", 15.0)


def test_taker_pays(spark, p_tables):
    """The other direction of a fill, and the complement that is rounded on its own at halves."""
    rows = [(1, "token_yes_a", "0", 1_000_000, 505_000), (1, "0", "token_no_a", 495_000, 1_000_000)]
    trades = spark.createDataFrame(
        rows, "block_number long, maker_asset_id string, taker_asset_id string, maker_amount long, taker_amount long"
    )
    got = sorted((r["price"], r["won"]) for r in venue_p.fill_positions(trades, p_tables["markets"]).collect())
    assert got == [(50.0, False), (50.0, False), (51.0, True), (51.0, True)]


def test_odd_sides_and_markets(spark, k_markets):
    """Blank and null sides take the other price; a blank side loses, a null side wins for neither; open markets are left out."""
    rows = [("MKT-A", 1, 60, 40, s, None) for s in ("yes", "", None)] + [("MKT-X", 1, 60, 40, "yes", None)]
    trades = spark.createDataFrame(
        rows, "ticker string, count long, yes_price int, no_price int, taker_side string, created_time timestamp_ntz"
    )
    markets = k_markets.unionByName(spark.createDataFrame([("MKT-X", "open", "", None, None)], k_markets.schema))
    got = {r["price"]: (r["total_trades"], r["wins"]) for r in venue_k.win_rate_by_price(trades, markets).collect()}
    assert got == {60: (3, 2), 40: (3, 0)}


def test_empty(k_trades, k_markets):
    for name in (
        "win_rate_by_price",
        "mispricing_by_price",
        "trade_size_by_role",
        "calibration_deviation_over_time",
        "longshot_volume_share_over_time",
        "maker_taker_returns_by_category"
    ):
        assert getattr(venue_k, name)(k_trades.limit(0), k_markets.limit(0)).count() == 0
