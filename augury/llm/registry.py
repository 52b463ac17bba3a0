"""Queries of this package by name; none has a SQL twin (see the tests for brute-force versions)."""

from __future__ import annotations

from augury.llm import queries as q


def queries() -> dict:
    return {n: f for n, f in vars(q).items() if n[0] == "p" and n[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
