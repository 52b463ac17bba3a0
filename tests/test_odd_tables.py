"""Every query runs on odd tables; extra columns change nothing."""

from __future__ import annotations

import pytest

from augury.plans.registry import queries

from . import odd

QUERIES = queries()
PLAIN = [n for n in QUERIES if n[0] == "p" and n[1:2].isdigit()]


@pytest.fixture(scope="module")
def folders(spark, small, tmp_path_factory):
    return {k: odd.write(spark, small, tmp_path_factory.mktemp(k), k) for k in ("empty", "nulls", "clash", "repeated")}


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, folders, name, kind):
    n = QUERIES[name](spark, folders[kind]).count()
    assert kind != "empty" or not name.endswith("_found") or n == 0


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_extra_columns(spark, small, folders, name):
    rows = lambda d: sorted(map(str, QUERIES[name](spark, d).collect()))
    assert rows(folders["clash"]) == rows(small)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p6_found"])
def test_repeated_rows_change_nothing(spark, small, folders, name):
    rows = lambda d: sorted(map(str, QUERIES[name](spark, d).collect()))
    assert rows(folders["repeated"]) == rows(small)
