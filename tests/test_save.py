"""Charts and saving."""

from __future__ import annotations

import csv
import json

from augury.plans import charts
from augury.plans.analysis import analyses, latex_macros


def test_chart_json():
    c = charts.bar([{"x": 1, "y": None}], "x", ("y", "z"), stacked=True, title="t", y_unit=charts.UnitType.DOLLARS)
    assert json.loads(c.to_json()) == {
        "type": "stacked-bar", "data": [{"x": 1, "y": None}], "xKey": "x", "yKeys": ["y", "z"], "title": "t", "yUnit": "dollars"
    }
    assert list(c.to_dict()) == ["type", "data", "xKey", "yKeys", "title", "yUnit"]
    assert charts.pie([], "n", "v").to_dict() == {"type": "pie", "data": [], "nameKey": "n", "valueKey": "v"}
    assert charts.scatter([], "x", "y", series=[charts.Series("s", [])]).to_dict()["series"] == [{"name": "s", "data": []}]


def test_tree():
    row = lambda level, g, c, s, v: {"level": level, "group": g, "category": c, "subcategory": s, "volume": v}
    rows = [
        row(1, "A", None, None, 10),
        row(1, "B", None, None, 20),
        row(2, "A", "x", None, 6),
        row(2, "A", "y", None, 4),
        row(2, "B", "z", None, 20),
        row(3, "A", "x", "k", 6)
    ]
    assert charts.tree_of(rows) == [
        {"name": "B", "value": 20}, {"name": "A", "value": 10, "children": [{"name": "x", "value": 6}, {"name": "y", "value": 4}]}
    ]


def test_save(spark, small, tmp_path):
    a = analyses()["ev_yes_vs_no"]
    saved = a.save(spark, small, tmp_path / "new" / "dir", ("csv", "json", "parquet", "gif"))
    assert set(saved) == {"csv", "json", "parquet"}
    with saved["csv"].open(encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(f))
    assert len(rows) == 99 and list(rows[0])[:2] == ["price", "yes_ev"]
    chart = json.loads(saved["json"].read_text())
    assert chart["type"] == "line" and len(chart["data"]) == 99 and all(p["yes_ev"] is not None for p in chart["data"])
    assert spark.read.parquet(str(saved["parquet"])).count() == 99
    assert set(analyses()["meta_stats"].save(spark, small, tmp_path, ("csv", "json"))) == {"csv"}


def test_every_analysis_is_named():
    found = analyses()
    assert all(a.name and a.description for a in found.values()) and len(found) > 60


def test_macros(spark, small):
    text = latex_macros(analyses()["meta_stats"].run(spark, small).rows())
    assert text.count("\\newcommand") == 6 and "\\numTrades" in text


def test_charts_of_all(spark, small):
    for a in analyses().values():
        if a.draw is not None:
            assert json.loads(a.draw(a.run(spark, small).rows()).to_json())["type"], a.name


def test_other_names_and_metrics(spark, small):
    found = analyses()
    a, b = found["longshot_volume_share_over_time"], found["longshot_volume_share"]
    assert a.run(spark, small).rows() == b.run(spark, small).rows() and a.name == "longshot_volume_share_over_time"
    assert set(found["polymarket_win_rate_by_price"].metrics(spark, small)) == {"brier_score", "log_loss", "ece", "total_trades"}
    assert found["win_rate_by_price_animated"].metrics(spark, small)["total_weeks"] >= 0 and b.metrics(spark, small) == {}
