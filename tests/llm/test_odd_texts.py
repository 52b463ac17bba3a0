"""The text queries on odd tables; extra columns change nothing."""

from __future__ import annotations

import pytest

from augury.llm.canon import Canon
from augury.llm.registry import queries
from tests import odd

QUERIES = queries()


@pytest.fixture(scope="module")
def folders(spark, small, tmp_path_factory):
    return {k: odd.write(spark, small, tmp_path_factory.mktemp(k), k) for k in ("empty", "nulls", "clash")}


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, folders, name, kind):
    n = QUERIES[name](spark, folders[kind]).count()
    assert kind != "empty" or n == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_extra_columns(spark, small, folders, name):
    rows = lambda d: sorted(map(str, QUERIES[name](spark, d).collect()))
    assert rows(folders["clash"]) == rows(small)


def test_twins_of_other_latin_letters(spark):
    """Letters of other scripts that look like a Latin letter outside ASCII."""
    canon = Canon.of(spark)
    for other, latin in ("әə", "ӘƏ", "ӕæ", "өɵ", "ϸþ", "βß"):
        assert canon(f"x{other}z") == canon(f"x{latin}z")
