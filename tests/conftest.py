"""Shared session and the small hand-made relations of the tests."""

from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])  # for the Python workers

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from augury.session import session

    return session("tests", 4, 4, "4g")


@pytest.fixture(scope="session")
def small() -> str:
    folder = TESTDATA / "sf0.001"
    if not folder.is_dir():
        pytest.skip("no test tables here")
    return str(folder)


NOON = datetime(2024, 6, 1, 12)


@pytest.fixture(scope="session")
def k_trades(spark):
    rows, n = [], 0
    for _ in range(100):
        for p in (10, 20, 30, 50, 60, 70, 90):
            for ticker, side, yes, count in (("MKT-A", "yes", p, 10), ("MKT-B", "no", 100 - p, 5), ("MKT-B", "yes", p, 3)):
                n += 1
                rows.append((str(n), ticker, count, yes, 100 - yes, side, NOON + timedelta(minutes=n)))
    return spark.createDataFrame(
        rows, "trade_id string, ticker string, count long, yes_price int, no_price int, taker_side string, created_time timestamp_ntz"
    )


@pytest.fixture(scope="session")
def k_markets(spark):
    rows = [("MKT-A", "finalized", "yes", 1000, "INXD-24JAN01"), ("MKT-B", "finalized", "no", 2000, "NFLGAME-25FEB01")]
    return spark.createDataFrame(rows, "ticker string, status string, result string, volume long, event_ticker string")


@pytest.fixture(scope="session")
def p_tables(spark):
    prices, tokens = (20, 40, 50, 60, 80), ("token_yes_a", "token_yes_b")
    fills = [(100 + k, "0", tokens[k % 2], prices[k // 2] * 10_000, 1_000_000) for k in range(10)]
    trades = spark.createDataFrame(
        fills, "block_number long, maker_asset_id string, taker_asset_id string, maker_amount long, taker_amount long"
    )
    legacy = spark.createDataFrame(
        [(200 + k, "0xfpmm_address_a", str(prices[k // 2] * 10_000), "1000000", k % 2) for k in range(10)],
        "block_number long, fpmm_address string, amount string, outcome_tokens string, outcome_index long"
    )
    markets = spark.createDataFrame(
        [
            ("market_a", '["token_yes_a","token_no_a"]', "[1.0, 0.0]", "0xfpmm_address_a", True),
            ("market_b", '["token_yes_b","token_no_b"]', "[0.0, 1.0]", None, True)
        ],
        "id string, clob_token_ids string, outcome_prices string, market_maker_address string, closed boolean",
    )
    stamp = lambda b: (datetime(2024, 6, 1, 12) + timedelta(seconds=2 * b)).strftime("%Y-%m-%dT%H:%M:%S+00:00")
    blocks = spark.createDataFrame([(b, stamp(b)) for b in [*range(100, 110), *range(200, 210)]], "block_number long, timestamp string")
    collateral = spark.createDataFrame(
        [("0xfpmm_address_a", "USDC", 6)], "fpmm_address string, collateral_symbol string, collateral_decimals int"
    )
    return {"trades": trades, "legacy": legacy, "markets": markets, "blocks": blocks, "collateral": collateral}
