"""Properties that hold for any input."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from augury.operators import orphans, packed, rolling, skew
from augury.plans import venue_k, views

sets = st.sets(st.integers(0, 400_000), max_size=300)


@given(sets, sets)
def test_bitmap_and_not(a, b):
    x, y = (orphans.KeyBitmap.of(np.array(sorted(s), dtype=np.int64)) for s in (a, b))
    assert x.and_not(y).decode().tolist() == sorted(a - b)


@given(st.dictionaries(st.integers(-300, 700), st.integers(0, 10**12), min_size=1, max_size=40), st.integers(1, 400))
def test_window_is_a_sum(days, width):
    d = np.array(sorted(days), dtype=np.int64)
    t = np.array([days[x] for x in d.tolist()], dtype=np.int64)
    forest = rolling.Forest.of_days(np.zeros(len(d), dtype=np.int64), d, t, np.ones(len(d), dtype=np.int64))
    e, day = forest.dates()
    assert forest.window(e, day, width).tolist() == [sum(v for k, v in days.items() if x - width < k <= x) for x in day.tolist()]


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=8).map(str.strip), min_size=2, max_size=6))
def test_json_lists_come_back(values):
    import json

    parsed = packed._parse(json.dumps(values))
    assert [a for a, _ in parsed[0]] == values
    atoms, seps = packed.read_atoms(json.dumps(values))
    assert [a for a, _ in atoms] == values and set(seps) == {","}


@settings(max_examples=30)
@given(st.integers(-(2**31), 2**31 - 1), st.lists(st.integers(0, 15), min_size=1, max_size=12))
def test_salts_lead_to_their_partitions(seed, where):
    salts = skew._salts(seed, where, 16)
    assert len(set(salts)) == len(salts) and min(salts) > 0
    assert (skew._murmur3_int(np.array(salts), seed).astype(np.int64) % 16).tolist() == where


def test_both_sides_of_a_trade(spark, small):
    trades, markets = views.k_trades(spark, small), views.k_markets(spark, small)
    rows = views.traded(trades, markets)
    by = {
        r["role"]: r for r in views.positions(rows).groupBy("role").agg(
            F.count("*").alias("n"), F.sum("count").alias("c"), F.sum("won").alias("w")
        ).collect()
    }
    assert by["taker"]["n"] == by["maker"]["n"] and by["taker"]["c"] == by["maker"]["c"]
    clear = rows.where(F.col("taker_side").isNotNull())
    assert clear.where(F.col("taker_won") + F.col("maker_won") != 1).count() == 0
    total = venue_k.win_rate_by_price(trades, markets).agg(F.sum("total_trades"), F.sum("wins")).first()
    assert tuple(total) == (2 * by["taker"]["n"], by["taker"]["w"] + by["maker"]["w"])


def test_one_scan_equals_union(spark, small):
    rows = views.traded(views.k_trades(spark, small), views.k_markets(spark, small))
    union = rows.select(F.lit("taker").alias("role"), F.col("taker_price").alias("price"), F.col("taker_won").alias("won"), "count", views.ALIKE).unionByName(
        rows.select(
            F.lit("maker").alias("role"), F.col("maker_price").alias("price"), F.col("maker_won").alias("won"), "count", views.ALIKE
        )
    )
    assert union.exceptAll(views.positions(rows)).count() == 0 and views.positions(rows).exceptAll(union).count() == 0


def test_compact_changes_nothing(spark, small):
    """Sums over compacted trades are those over trades."""
    trades, markets = views.k_trades(spark, small), views.k_markets(spark, small)
    sums = lambda t: sorted(
        map(
            tuple,
            views.positions(views.traded(t, markets)).groupBy("role", "price").agg(
                F.sum(views.ALIKE), F.sum(F.col(views.ALIKE) * F.col("won")), F.sum("count")
            ).collect()
        ),
        key=str
    )
    assert sums(views.compact(trades)) == sums(trades)


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = venue_k.win_rate_by_price(
        views.k_trades(spark, small), views.k_markets(spark, small)
    )._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 2 and not any("title" in x or "open_interest" in x for x in scans)
