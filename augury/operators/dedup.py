"""At-least-once deliveries: rank the copies of a message by arrival, keep the first, admit new batches.

Copies are ranked in a window over the message identifier, earliest arrival first, ties broken by the
remaining columns in name order, so every run keeps the same copy.  An identifier that holds more than
an even share of rows is ranked in shards (see :mod:`augury.operators.skew`) whose winners are ranked
once more; all others need one shuffle and no second look.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.operators.skew import SALT, LoadPlan, plan_loads

RANK = "__rank"


def _order(df: DataFrame, arrival: str, ties: Sequence[str] | None) -> list[Column]:
    if ties is None:
        ties = sorted(c for c, kind in df.dtypes if not c.startswith("__") and c != arrival and not kind.startswith(("map", "variant")))
    return [F.col(arrival).asc_nulls_last(), *(F.col(f"`{c}`").asc_nulls_last() for c in ties)]


def _ranked(df: DataFrame, key: str, arrival: str, ties: Sequence[str] | None, plan: LoadPlan) -> DataFrame:
    by = [key, SALT] if plan.salts else [key]
    rows = plan.scatter(df, key) if plan.salts else df
    return rows.withColumn(RANK, F.row_number().over(Window.partitionBy(*by).orderBy(*_order(df, arrival, ties))))


def keep_first(df: DataFrame, key: str, arrival: str, ties: Sequence[str] | None = None, plan: LoadPlan | None = None) -> DataFrame:
    """One row per ``key``: the earliest by ``arrival``; rows with a null key are all kept.

    The rank filter lets Spark cut each task's copies of a key to one before the shuffle.  Null keys are
    told apart by row numbers within a task, so ``df`` must come in a fixed order, as a scan does.
    """
    plan = plan or LoadPlan(1, 0)
    alone = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    rows = df.withColumn("__key", F.coalesce(F.col(f"`{key}`").cast("string"), alone))
    first = _ranked(rows, "__key", arrival, ties, plan).where(F.col(RANK) == 1)
    if plan.salts:
        first = first.drop(RANK, SALT).withColumn(
            RANK, F.row_number().over(Window.partitionBy("__key").orderBy(*_order(df, arrival, ties)))
        ).where(F.col(RANK) == 1)
    return first.drop(RANK, "__key", SALT)


def copy_counts(df: DataFrame, key: str, arrival: str, ties: Sequence[str] | None = None, plan: LoadPlan | None = None) -> DataFrame:
    """``(key, n_copies)`` of the identifiers with more than one row; null identifiers are all different.

    The last rank within an identifier is its number of copies.  Only shards of hot identifiers and
    identifiers with copies reach the second step.
    """
    plan = plan or plan_loads(df, key)
    by = [key, SALT] if plan.salts else [key]
    ranked = _ranked(df.where(F.col(key).isNotNull()), key, arrival, ties, plan)
    counts = ranked.groupBy(*by).agg(F.max(RANK).cast("long").alias("n_copies"))
    if plan.salts:
        counts = counts.where((F.col("n_copies") > 1) | (F.col(SALT) > 0)).groupBy(key).agg(F.sum("n_copies").alias("n_copies"))
    return counts.where(F.col("n_copies") > 1).select(key, "n_copies")


def admit(stored: DataFrame, batch: DataFrame, key: str, arrival: str, ties: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``batch`` to append: the first copy of each identifier that ``stored`` does not have.

    Null identifiers are always admitted.  Replaying a batch admits nothing new with an identifier.
    Stored identifiers are first cut down to those of the batch: a batch that is small enough to be
    broadcast, by the size checks of adaptive execution, spares the shuffle of all identifiers ever stored.
    """
    fresh = batch.select(F.col(f"`{key}`").alias("__fresh")).where(F.col("__fresh").isNotNull()).distinct()
    known = stored.select(F.col(f"`{key}`").alias("__known")).join(fresh, F.col("__known") == F.col("__fresh"), "left_semi").distinct()
    return keep_first(batch, key, arrival, ties).join(known, F.col(f"`{key}`") == F.col("__known"), "left_anti")
