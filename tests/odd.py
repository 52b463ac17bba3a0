"""Odd versions of the stored tables: empty, nulls everywhere, clashing extra columns, repeated rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Names that operators use for columns of their own.
CLASHING = (
    "hot_key",
    "msg_key",
    "src",
    "unit",
    "told",
    "read",
    "power",
    "number",
    "sure",
    "pos",
    "item",
    "items",
    "record",
    "role",
    "month",
    "entity",
    "day",
    "total",
    "n",
    "n_rows",
    "form",
    "raw",
    "ids",
    "key",
    "k",
    "val",
    "rec_key",
    "at",
    "seen",
    "__rank",
    "__salt",
    "__key",
    "__group",
    "key_range",
    "price",
    "won",
    "side",
    "cents",
    "bucket",
    "quarter",
    "doc_a",
    "item_id",
    "market_id",
    "row",
)


def write(spark: SparkSession, source: str, out: Path, kind: str) -> str:
    """Writes every table of ``source`` in one odd version to ``out``; returns the folder."""
    for path in sorted(Path(source).glob("*.parquet")):
        df = spark.read.parquet(str(path))
        if kind == "empty":
            df = df.limit(0)
        elif kind == "nulls":
            key = {"unit_defs": df.columns}.get(path.stem, [])
            blank = lambda c, i: F.when((F.xxhash64(*df.columns) + i) % 3 != 0, F.col(f"`{c}`")).alias(c)  # noqa: B023, E731
            df = df.select(*(F.col(c) if c in key else blank(c, i) for i, c in enumerate(df.columns))).unionByName(
                df.limit(1).select(*(F.lit(None).cast(t).alias(c) if c not in key else F.col(c) for c, t in df.dtypes))
            )
        elif kind == "clash":
            taken = {c.lower() for c in df.columns}
            df = df.select("*", *(F.lit("zz").alias(c) for c in CLASHING if c.lower() not in taken))
        elif kind == "repeated" and path.stem != "documents":
            df = df.unionByName(df)
        df.coalesce(1).write.parquet(str(out / path.name))
    return str(out)
