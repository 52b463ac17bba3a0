"""Fragment-replicate by estimated load: per-key work without a task that holds a hot key alone.

1. *Estimate.*  One pass over the key column counts the rows of each hash partition; a frequent-items
   sketch names the keys that alone exceed half of an even share.  Both results are bounded by the
   number of partitions, never by the number of keys.
2. *Pack.*  A key above an even share is cut into shards in proportion to its load.  Shards go, largest
   first, to the partition with the least load so far, on top of the light keys that hash there.
3. *Place.*  Each shard gets a salt chosen so that Spark's own hash partitioner sends ``(key, salt)`` to
   the partition it was packed on.  The plan stays an ordinary equi-join or aggregate on two columns.
4. *Replicate.*  The matching side is repeated only for the salts of the hot keys.

Nothing is dropped or sampled.  An estimate that is off moves load, never a result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALT = "__salt"
_HOT = T.StructType([T.StructField("__hot_key", T.StringType()), T.StructField("__salts", T.ArrayType(T.IntegerType()))])


def _murmur3_int(value: np.ndarray, seed: int) -> np.ndarray:
    """Spark's 32-bit Murmur3 of ints, as ``hash(key, salt)`` continues from ``hash(key)``."""
    with np.errstate(over="ignore"):
        k = value.astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(seed & 0xFFFFFFFF) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


@dataclass(frozen=True)
class LoadPlan:
    """Where the rows of each key go.

    ``total`` counts all rows, null keys too.  ``salts`` has, for each hot key, one salt per shard;
    every other key has the salt 0.  ``loads`` is the expected number of rows per partition.
    """

    partitions: int
    total: int
    salts: dict[str, list[int]] = field(default_factory=dict)
    loads: tuple[int, ...] = ()

    def hot(self, spark: SparkSession) -> DataFrame:
        """The hot keys; at most two per partition, so small enough to broadcast at any input size."""
        return F.broadcast(spark.createDataFrame(list(self.salts.items()), _HOT))

    def scatter(self, df: DataFrame, key: str) -> DataFrame:
        """Adds the salt: rows of a hot key take its shards in turn, all others get 0.

        Turns are row numbers within a task, so ``df`` must come in a fixed order, as a scan does: a task
        that runs again must deal its rows alike.  After a shuffle keep the salt that rows have.
        """
        if not self.salts:
            return df.withColumn(SALT, F.lit(0))
        turn = F.monotonically_increasing_id() + F.spark_partition_id()
        df = df.withColumn("__turn", turn).join(self.hot(df.sparkSession), F.col(key) == F.col("__hot_key"), "left")
        at = F.element_at("__salts", (F.col("__turn") % F.size("__salts") + 1).cast("int"))
        return df.withColumn(SALT, F.when(F.col("__hot_key").isNull(), F.lit(0)).otherwise(at)).drop("__hot_key", "__salts", "__turn")

    def replicate(self, df: DataFrame, key: str) -> DataFrame:
        """Repeats a row for each salt of its key: only rows of hot keys are repeated."""
        if not self.salts:
            return df.withColumn(SALT, F.lit(0))
        df = df.join(self.hot(df.sparkSession), F.col(key) == F.col("__hot_key"), "left")
        return df.withColumn(SALT, F.explode(F.coalesce("__salts", F.array(F.lit(0))))).drop("__hot_key", "__salts")


def frequent_keys(df: DataFrame, key: Column, count: int) -> list[tuple[str, int]]:
    """Keys that may hold at least 1/``count`` of the rows, with estimated rows, by a bounded sketch."""
    count = min(count, 100_000)
    tracked = min(max(1024, 8 * count), 1_000_000)  # limits of the sketch
    sketch = df.where(key.isNotNull()).select(key.alias("k")).agg(F.expr(f"approx_top_k(k, {count}, {tracked})").alias("s"))
    return [(x["item"], x["count"]) for x in (sketch.first()["s"] or [])]


def plan_loads(df: DataFrame, key: Column | str, partitions: int | None = None) -> LoadPlan:
    """Estimates loads and packs shards (see the module text); runs two small jobs over the key alone."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(key) if isinstance(key, str) else key
    part = F.pmod(F.hash(key, F.lit(0)), F.lit(n))
    loads = np.zeros(n, dtype=np.int64)
    for row in df.groupBy(part.alias("p")).count().collect():  # one row per partition
        loads[row["p"]] = row["count"]
    total = int(loads.sum())
    share = max(1, total // n)
    hot = [(k, c) for k, c in frequent_keys(df, key, 2 * n) if c > share] if n > 1 and total else []
    if not hot:
        return LoadPlan(n, total, {}, tuple(loads.tolist()))
    seeds = {
        r["k"]: (r["h"], r["p"])
        for r in spark.createDataFrame(hot, "k string, c long").select(
            "k", F.hash("k").alias("h"), F.pmod(F.hash("k", F.lit(0)), F.lit(n)).alias("p")
        ).collect()
    }
    shards: list[tuple[float, str]] = []
    for k, c in hot:
        loads[seeds[k][1]] = max(0, loads[seeds[k][1]] - c)
        shards += [(c / (m := -(-c // share)), k)] * m
    heap = [(int(x), p) for p, x in enumerate(loads)]
    heapq.heapify(heap)
    placed: dict[str, list[int]] = {}
    for size, k in sorted(shards, reverse=True):
        load, p = heapq.heappop(heap)
        placed.setdefault(k, []).append(p)
        loads[p] = load + int(size)
        heapq.heappush(heap, (int(loads[p]), p))
    return LoadPlan(n, total, {k: _salts(seeds[k][0], where, n) for k, where in placed.items()}, tuple(loads.tolist()))


def _salts(seed: int, where: Sequence[int], n: int) -> list[int]:
    """The smallest salts, all different and above 0, that lead from this key to these partitions."""
    free: dict[int, list[int]] = {}
    for p in where:
        free.setdefault(p, [])
    need, start, step = {p: list(where).count(p) for p in free}, 1, 16 * n
    while any(len(free[p]) < need[p] for p in free):
        salts = np.arange(start, start + step, dtype=np.int64)
        at = _murmur3_int(salts, seed).astype(np.int64) % n
        for p in free:
            free[p] += salts[at == p][: need[p]].tolist()
        start += step
    return [free[p].pop(0) for p in where]


def balanced_totals(
    df: DataFrame, key: str, aggregates: Sequence[Column], merges: Sequence[Column], plan: LoadPlan | None = None
) -> DataFrame:
    """Per-key aggregates: ``aggregates`` per shard, then ``merges`` over the shards of a key.

    Rows with a null key form no group.  Partial aggregation runs before both shuffles, so a shuffle
    moves one row per key, shard and task.  An empty table gives no rows.  Rows that carry a salt already
    (from :func:`fragment_replicate_join`) keep it.
    """
    rows = df.where(F.col(key).isNotNull())
    if SALT not in df.columns:
        rows = (plan or plan_loads(df, key)).scatter(rows, key)
    parts = rows.groupBy(key, SALT).agg(*aggregates)
    return parts.groupBy(key).agg(*merges)


def fragment_replicate_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "left", plan: LoadPlan | None = None, keep_salt: bool = False
) -> DataFrame:
    """Joins a skewed ``left`` to ``right`` on ``key``; the shards of a hot key run as separate tasks.

    ``how`` is ``inner`` or ``left``.  Null keys match nothing.  ``right`` may repeat keys, with the
    usual result of a join; its columns must differ from those of ``left`` except for the key.
    ``keep_salt`` leaves the salt in the result, for totals over the same shards without a new shuffle.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    plan = plan or plan_loads(left, key)
    return plan.scatter(left, key).join(
        plan.replicate(right.where(F.col(key).isNotNull()), key), [key, SALT], how
    ) if keep_salt else fragment_replicate_join(left, right, key, how, plan, True).drop(SALT)


def hot_keys(df: DataFrame, key: str, share: float, plan: LoadPlan | None = None) -> DataFrame:
    """``(key, n_rows)`` of the keys with at least ``share`` of all rows, null keys counted in the total."""
    plan = plan or plan_loads(df, key)
    totals = balanced_totals(df.select(key), key, [F.count("*").alias("__n")], [F.sum("__n").alias("n_rows")], plan)
    part = Fraction(str(share))  # compared in whole numbers, so a key at exactly the share counts
    return totals.where(F.col("n_rows") * F.lit(part.denominator) >= F.lit(part.numerator * plan.total))
