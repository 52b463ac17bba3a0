"""Chart descriptions as plain data, and their JSON form."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from enum import Enum
from typing import Any


class ChartType(Enum):
    """Names of the chart format."""

    LINE = "line"
    BAR = "bar"
    STACKED_BAR = "stacked-bar"
    STACKED_BAR_100 = "stacked-bar-100"
    AREA = "area"
    STACKED_AREA_100 = "stacked-area-100"
    PIE = "pie"
    SCATTER = "scatter"
    HEATMAP = "heatmap"
    TREEMAP = "treemap"


class UnitType(Enum):
    """Names of the chart format."""

    DOLLARS = "dollars"
    PERCENT = "percent"
    BYTES = "bytes"
    ETH = "eth"
    BTC = "btc"
    CENTS = "cents"
    NUMBER = "number"


class ScaleType(Enum):
    """Names of the chart format."""

    LINEAR = "linear"
    LOG = "log"


@dataclass(frozen=True)
class Series:
    """Points of one named series."""

    name: str
    data: list[dict[str, Any]]


@dataclass(frozen=True)
class Chart:
    """What to draw; options that are not set do not appear in the output."""

    # The order in which options appear in the format.
    type: ChartType
    data: list[Any]
    series: tuple[Series, ...] | None = None
    x_key: str | None = None
    y_keys: tuple[str, ...] | None = None
    y_key: str | None = None
    z_key: str | None = None
    title: str | None = None
    height: int | None = None
    stacked: bool | None = None
    name_key: str | None = None
    value_key: str | None = None
    children_key: str | None = None
    x_scale: ScaleType | None = None
    y_scale: ScaleType | None = None
    y_unit: UnitType | None = None
    stroke_dasharrays: tuple[str | None, ...] | None = None
    caption: str | None = None
    colors: dict[str, str] | None = field(default=None)
    x_label: str | None = None
    y_label: str | None = None

    def to_dict(self) -> dict[str, Any]:
        """Keys in camel case, in the order of the fields; enums by value; unset options left out."""
        out: dict[str, Any] = {}
        for f in fields(self):
            if (value := getattr(self, f.name)) is None:
                continue
            head, *rest = f.name.split("_")
            if isinstance(value, Enum):
                value = value.value
            elif f.name == "series":
                value = [{"name": s.name, "data": s.data} for s in value]
            elif isinstance(value, tuple):
                value = list(value)
            out[head + "".join(map(str.title, rest))] = value
        return out

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str, ensure_ascii=False)


Rows = Sequence[dict[str, Any]]


def line(rows: Rows, x: str, y: str | Sequence[str], **options: Any) -> Chart:
    return _xy(ChartType.LINE, rows, x, y, options)


def bar(rows: Rows, x: str, y: str | Sequence[str], stacked: bool = False, share: bool = False, **options: Any) -> Chart:
    return _xy(ChartType.STACKED_BAR_100 if share else ChartType.STACKED_BAR if stacked else ChartType.BAR, rows, x, y, options)


def area(rows: Rows, x: str, y: str | Sequence[str], stacked: bool = False, share: bool = False, **options: Any) -> Chart:
    return _xy(ChartType.STACKED_AREA_100 if share else ChartType.AREA, rows, x, y, options | {"stacked": stacked})


def pie(rows: Rows, name: str = "name", value: str = "value", **options: Any) -> Chart:
    return Chart(ChartType.PIE, list(rows), name_key=name, value_key=value, **options)


def scatter(rows: Rows, x: str, y: str, z: str | None = None, series: Sequence[Series] | None = None, **options: Any) -> Chart:
    return Chart(ChartType.SCATTER, list(rows), tuple(series) if series else None, x, (y,), z_key=z, **options)


def heatmap(rows: Rows, x: str, y: str, value: str = "value", **options: Any) -> Chart:
    return Chart(ChartType.HEATMAP, list(rows), x_key=x, y_key=y, value_key=value, **options)


def treemap(tree: list[dict[str, Any]], name: str = "name", value: str = "value", children: str = "children", **options: Any) -> Chart:
    return Chart(ChartType.TREEMAP, tree, name_key=name, value_key=value, children_key=children, **options)


def _xy(kind: ChartType, rows: Rows, x: str, y: str | Sequence[str], options: dict[str, Any]) -> Chart:
    return Chart(kind, list(rows), x_key=x, y_keys=(y,) if isinstance(y, str) else tuple(y), **options)


def tree_of(rows: Rows) -> list[dict[str, Any]]:
    """Nested groups from the rows of ``market_type_tree``, largest first; an only child is left out."""

    def node(level: int, keys: tuple, row: dict) -> dict[str, Any]:
        names = ("group", "category", "subcategory")
        below = [r for r in rows if r["level"] == level + 1 and tuple(r[k] for k in names[:level]) == keys]
        out: dict[str, Any] = {"name": keys[-1], "value": row["volume"]}
        if len(below) > 1:
            out["children"] = [
                node(level + 1, (*keys, r[names[level]]), r) for r in sorted(below, key=lambda r: (-r["volume"], str(r[names[level]])))
            ]
        return out

    top = [r for r in rows if r["level"] == 1]
    return [node(1, (r["group"],), r) for r in sorted(top, key=lambda r: (-r["volume"], r["group"]))]
