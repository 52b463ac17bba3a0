"""Running an analysis by name and saving its table, chart and figure."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from augury.functions.classify import group_colors
from augury.plans import charts, registry

log = logging.getLogger(__name__)
TABLES, CHARTS, FIGURES = ("csv", "parquet"), ("json",), ("png", "pdf", "svg")
DEFAULT_FORMATS = ("png", "pdf", "csv")
MOST_ROWS = 1_000_000
#: Analyses with summary figures, and the query that has them in one row.
METRICS = {"polymarket_win_rate_by_price": "calibration_metrics", "polymarket_calibration_by_bucket": "bucket_metrics"}
#: Other names that an analysis answers to.
ALIASES = {
    "maker_taker_gap_over_time": "maker_taker_gap_quarterly",
    "maker_taker_returns_by_category": "returns_by_category",
    "longshot_volume_share_over_time": "longshot_volume_share",
    "kalshi_calibration_deviation_over_time": "calibration_deviation_weekly",
}
Drawn = Callable[[list[dict[str, Any]]], charts.Chart]


class TooManyRows(ValueError):
    """A result is too large to be held in one place."""


@dataclass
class Result:
    """A lazy table, with a chart of its rows where the analysis has one."""

    data: DataFrame
    chart: Drawn | None = None

    def rows(self) -> list[dict[str, Any]]:
        """The table's rows, which must be few: results are aggregates.  Larger ones raise."""
        got = self.data.limit(MOST_ROWS + 1).collect()
        if len(got) > MOST_ROWS:
            raise TooManyRows(f"more than {MOST_ROWS} rows: write the table with Spark instead")
        return [r.asDict(recursive=True) for r in got]


@dataclass(frozen=True)
class Analysis:
    """A named query with its chart."""

    name: str
    description: str
    build: Callable[[SparkSession, str], DataFrame]
    draw: Drawn | None = None

    def run(self, spark: SparkSession, folder: str) -> Result:
        return Result(self.build(spark, folder), self.draw)

    def metrics(self, spark: SparkSession, folder: str) -> dict[str, Any]:
        """Summary figures beside the table; empty where the analysis has none."""
        if self.name == "win_rate_by_price_animated":
            return {"total_weeks": registry.queries()["every_other_day"](spark, folder).count()}
        if self.name not in METRICS:
            return {}
        return registry.queries()[METRICS[self.name]](spark, folder).first().asDict()

    @contextmanager
    def progress(self, what: str) -> Iterator[None]:
        began = time.monotonic()
        log.info("%s: %s", self.name, what)
        yield
        log.info("%s: %s took %.1f s", self.name, what, time.monotonic() - began)

    def save(
        self, spark: SparkSession, folder: str, out: str | Path, formats: Sequence[str] = DEFAULT_FORMATS, dpi: int = 300
    ) -> dict[str, Path]:
        """Writes ``<out>/<name>.<format>``; formats that do not fit the result are skipped.

        csv and json come from the collected aggregate, parquet is written by Spark.  A result of more than
        ``MOST_ROWS`` rows is no aggregate: Spark writes its csv as a folder, and it has no chart.  Figures
        need matplotlib and a chart.
        """
        out = Path(out)
        out.mkdir(parents=True, exist_ok=True)
        result, saved = self.run(spark, folder), {}
        path = lambda f: out / f"{self.name}.{f}"
        if "parquet" in formats:
            result.data.write.mode("overwrite").parquet(str(path("parquet")))
            saved["parquet"] = path("parquet")
        if not set(formats) - {"parquet"}:
            return saved
        with self.progress("collecting"):
            try:
                rows = result.rows()
            except TooManyRows:
                if "csv" in formats:
                    result.data.write.mode("overwrite").option("header", True).csv(str(path("csv")))
                    saved["csv"] = path("csv")
                return saved
        if "csv" in formats:
            import csv

            with path("csv").open("w", encoding="utf-8", newline="") as f:
                w = csv.DictWriter(f, result.data.columns)
                w.writeheader()
                w.writerows(rows)
            saved["csv"] = path("csv")
        if result.chart is None:
            return saved
        chart = result.chart(rows)
        if "json" in formats:
            path("json").write_text(chart.to_json(), encoding="utf-8")
            saved["json"] = path("json")
        return saved | _figures(chart, {f: path(f) for f in formats if f in FIGURES}, dpi)


def _figures(chart: charts.Chart, paths: dict[str, Path], dpi: int) -> dict[str, Path]:
    if not paths or chart.x_key is None or not chart.y_keys:
        return {}
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return {}
    figure, axes = plt.subplots(figsize=(10, 7))
    for key in chart.y_keys:
        axes.plot([r[chart.x_key] for r in chart.data], [r[key] for r in chart.data], label=key)
    axes.set(xlabel=chart.x_label or chart.x_key, title=chart.title or "")
    axes.legend()
    for path in paths.values():
        figure.savefig(path, dpi=dpi)
    plt.close(figure)
    return paths


def _fill(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Missing values as 0, for charts only."""
    return [{k: 0 if v is None else v for k, v in r.items()} for r in rows]


def _dense(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """A row for each price 1..99, missing ones 0, for charts only."""
    by = {r["price"]: r for r in rows}
    keys = list(rows[0]) if rows else ["price"]
    return _fill([by.get(p, dict.fromkeys(keys) | {"price": p}) for p in range(1, 100)])


_PRICE = {"x_label": "Price (cents)"}
_USD = {"y_unit": charts.UnitType.DOLLARS}
_PCT = {"y_unit": charts.UnitType.PERCENT}
_DRAWN: dict[str, tuple[str, Drawn | None]] = {
    "win_rate_by_price": (
        "Win rate against price",
        lambda r: charts.line([x for x in r if x["price"] and 1 <= x["price"] <= 99], "price", "win_rate", **_PRICE, **_PCT)
    ),
    "mispricing_by_price": (
        "Mispricing against price",
        lambda r: charts.line(r, "price", ("taker_mispricing_pp", "maker_mispricing_pp", "combined_mispricing_pp"), **_PRICE, **_PCT)
    ),
    "maker_vs_taker_returns": (
        "Excess returns of makers and takers by price", lambda r: charts.line(r, "price", ("taker_excess", "maker_excess"), **_PRICE)
    ),
    "maker_returns_by_direction": (
        "Makers' excess returns on YES and NO", lambda r: charts.line(_fill(r), "price", ("yes_excess", "no_excess"), **_PRICE)
    ),
    "maker_win_rate_by_direction": (
        "Makers' win rates on YES and NO",
        lambda r: charts.line(_fill(r), "price", ("yes_win_rate", "no_win_rate", "implied_prob"), **_PRICE)
    ),
    "maker_taker_gap_quarterly": (
        "Returns of makers and takers by quarter", lambda r: charts.line(r, "quarter", ("taker_return", "maker_return"), **_PCT)
    ),
    "returns_by_category": ("Returns by category", lambda r: charts.bar(r[:8], "group", ("taker_excess", "maker_excess"), **_PCT)),
    "trade_size_by_role": (
        "Trade size of makers and takers", lambda r: charts.bar(r, "role", ("mean_trade_size", "median_trade_size"), **_USD)
    ),
    "win_rate_by_trade_size": (
        "Win rate by trade size", lambda r: charts.line(r, "trade_size_bin", "excess_win_rate", x_scale=charts.ScaleType.LOG)
    ),
    "returns_by_hour": ("Returns by hour", lambda r: charts.line([x for x in r if x["hour_et"] is not None], "hour_et", "excess_return")),
    "vwap_by_hour": ("Volume-weighted price by hour", lambda r: charts.line([x for x in r if x["hour_et"] is not None], "hour_et", "vwap")),
    "volume_over_time": ("Volume by quarter", lambda r: charts.bar(r, "quarter", "volume_usd", **_USD)),
    "longshot_volume_share": ("Share of volume in longshots", lambda r: charts.line(r, "quarter", "longshot_share", **_PCT)),
    "price_bucket_pivot": (
        "Volume by price bucket", lambda r: charts.area(r, "quarter", [k for k in (r[0] if r else ()) if k != "quarter"], share=True)
    ),
    "yes_vs_no_by_price": (
        "YES and NO contracts by price",
        lambda r: charts.bar(r, "price", ("taker_yes_pct", "taker_no_pct", "maker_yes_pct", "maker_no_pct"), share=True, **_PRICE)
    ),
    "ev_yes_vs_no": ("Expected value of YES and NO", lambda r: charts.line(_dense(r), "price", ("yes_ev", "no_ev"), **_PRICE)),
    "calibration_deviation_weekly": (
        "Calibration deviation over time", lambda r: charts.line(r, "date", "mean_absolute_deviation", **_PCT)
    ),
    "market_types": ("Volume by type of market", lambda r: charts.pie(r, "group", "total_volume", colors=group_colors(x["group"] for x in r))),
    "market_types_rollup": ("Volume by type of market, three levels", lambda r: charts.treemap(charts.tree_of(r))),
    "meta_stats": ("Size of the data", None),
    "statistical_tests": ("Statistical tests", None),
    "polymarket_win_rate_by_price": (
        "Win rate against price, on-chain venue", lambda r: charts.line(r, "price", "win_rate", **_PRICE, **_PCT)
    ),
    "polymarket_calibration_by_bucket": (
        "Calibration by ten cents", lambda r: charts.bar(r, "bucket_low", ("mean_predicted", "actual_rate"), **_PCT)
    ),
    "polymarket_trades_over_time": ("Trades per block", lambda r: charts.line(r, "datetime", "trade_count")),
    "polymarket_volume_over_time": ("Volume by quarter, on-chain venue", lambda r: charts.bar(r, "quarter", "volume_usd", **_USD)),
    "win_rate_by_price_animated": (
        "Cumulative win rate of both venues",
        lambda r: charts.scatter(
            r,
            "price",
            "win_rate",
            series=[charts.Series(p, [x for x in r if x["platform"] == p]) for p in sorted({x["platform"] for x in r})],
            **_PRICE
        )
    ),
}


def analyses() -> dict[str, Analysis]:
    """Every analysis by name and other name; queries without a chart of their own have a table only."""
    known = registry.queries()
    names = {n: n for n in known} | ALIASES
    return {n: Analysis(n, *_split(of, known[of])) for n, of in names.items()}


def _split(name: str, query: registry.Query) -> tuple[str, registry.Query, Drawn | None]:
    description, draw = _DRAWN.get(name, ((query.__doc__ or title(name)).strip().splitlines()[0], None))
    return description, query, draw


def title(name: str) -> str:
    """``snake_case`` as a title."""
    return " ".join(map(str.capitalize, name.split("_")))


def latex_macros(rows: Sequence[dict[str, Any]]) -> str:
    """Macros for the figures of ``meta_stats``."""
    by = {r["metric"]: r["formatted"] for r in rows}
    names = {
        "numTrades": "num_trades",
        "numTradesMillions": "num_trades_millions",
        "totalVolume": "total_volume",
        "totalVolumeBillions": "total_volume_billions",
        "numMarkets": "num_markets",
        "numEvents": "num_events"
    }
    return "\n".join(f"\\newcommand{{\\{k}}}{{{by[v]}}}" for k, v in names.items())
