"""Totals over trailing periods, days without activity included, from segment trees.

Activity is summed per entity and day in the JVM.  The days of an entity are cut into shards of 64; each
shard is a segment tree whose nodes 1..127 hold the sum and the number of rows of the days below them.
:func:`tree_table` gives one row per tree, :func:`answer` answers range queries from such rows: a window
is a query over at most two trees, plus the roots of those in between.  :func:`correct_trees` adds late
corrections to the ancestors of the corrected days; :func:`write_trees` and :func:`correct_stored` keep
the trees as a table by shard, of which a batch of corrections rewrites the touched shards only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.operators.lineage import cut

LEVELS = 6
LEAVES = 1 << LEVELS
DATES_AT_ONCE = 1_000_000


def build_trees(tree: np.ndarray, n_trees: int, day: np.ndarray, total: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node sums and row counts of trees 0..n_trees - 1 from the days of each; totals are exact ints."""
    sums = np.zeros((n_trees, 2 * LEAVES), dtype=np.int64)
    counts = np.zeros_like(sums)
    for nodes, x in ((sums, total), (counts, rows)):
        np.add.at(nodes, (tree, LEAVES + day % LEAVES), x)
        for node in range(LEAVES - 1, 0, -1):
            nodes[:, node] = nodes[:, 2 * node] + nodes[:, 2 * node + 1]
    return sums, counts


class Forest:
    """Segment trees of many entities; entity ``e`` owns the rows ``base[e] .. base[e + 1] - 1`` of the node arrays."""

    def __init__(self, entity: np.ndarray, shard: np.ndarray, sums: np.ndarray, counts: np.ndarray):
        """Stored trees, one per entity (0, 1, ...) and shard with activity, sorted by both."""
        starts = np.flatnonzero(np.r_[True, np.diff(entity) > 0])
        ends = np.r_[starts[1:], len(entity)] - 1
        active = counts[:, LEAVES:] > 0
        self.first = shard[starts] * LEAVES + active[starts].argmax(axis=1)
        self.last = shard[ends] * LEAVES + LEAVES - 1 - active[ends][:, ::-1].argmax(axis=1)
        self.shard0 = shard[starts]
        self.base = np.r_[0, np.cumsum(shard[ends] - self.shard0 + 1)]
        at = self.base[entity] + shard - self.shard0[entity]
        if len(at) == self.base[-1]:
            self.sums, self.counts = sums, counts
        else:  # shards without activity have no stored tree
            self.sums = np.zeros((self.base[-1], 2 * LEAVES), dtype=np.int64)
            self.counts = np.zeros_like(self.sums)
            self.sums[at], self.counts[at] = sums, counts
        self.before = np.r_[0, np.cumsum(self.sums[:, 1])]

    @classmethod
    def of_days(cls, entity: np.ndarray, day: np.ndarray, total: np.ndarray, rows: np.ndarray) -> Forest:
        """From rows sorted by entity and day, one per entity and day."""
        pairs, tree = np.unique(np.stack([entity, day // LEAVES]), axis=1, return_inverse=True)
        return cls(pairs[0], pairs[1], *build_trees(tree.ravel(), pairs.shape[1], day, total, rows))

    def _within(self, shard: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sums of the leaves ``left .. right`` of one tree each; 0 where left > right."""
        out = np.zeros(len(shard), dtype=np.int64)
        lo, hi = left + LEAVES, right + LEAVES + 1
        for _ in range(LEVELS + 1):
            take = (lo < hi) & (lo & 1 == 1)
            out[take] += self.sums[shard[take], lo[take]]
            lo = lo + take
            take = (lo < hi) & (hi & 1 == 1)
            hi = hi - take
            out[take] += self.sums[shard[take], hi[take]]
            lo, hi = lo >> 1, hi >> 1
        return out

    def window(self, entity: np.ndarray, day: np.ndarray, days: int) -> np.ndarray:
        """Sums over the ``days`` days that end with ``day``; days before the first add nothing."""
        start = np.maximum(day - days + 1, self.first[entity])
        base, shard0 = self.base[entity], self.shard0[entity]
        s0, s1 = base + start // LEAVES - shard0, base + day // LEAVES - shard0
        one = s0 == s1
        out = self._within(s1, np.where(one, start % LEAVES, 0), day % LEAVES)
        many = ~one
        out[many] += self._within(s0[many], start[many] % LEAVES, np.full(many.sum(), LEAVES - 1))
        out[many] += self.before[s1[many]] - self.before[s0[many] + 1]
        return out

    def dates(self) -> tuple[np.ndarray, np.ndarray]:
        """Entity and day of every date from each entity's first to its last."""
        n = self.last - self.first + 1
        entity = np.repeat(np.arange(len(n)), n)
        return entity, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[entity]

    def active(self, entity: np.ndarray, day: np.ndarray) -> np.ndarray:
        """Rows recorded on each day."""
        return self.counts[self.base[entity] + day // LEAVES - self.shard0[entity], LEAVES + day % LEAVES]


def daily(df: DataFrame, entity: str, at: str, amount: str) -> DataFrame:
    """``(entity, day, total, n_rows)``; day counts from 1970-01-01.

    Rows without entity or time are left out; a null amount adds nothing but makes the day active.
    """
    day = F.unix_date(F.to_date(at))
    return df.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(entity).alias("entity"), day.alias("day")).agg(
        F.coalesce(F.sum(amount), F.lit(0)).cast("long").alias("total"), F.count("*").alias("n_rows")
    )


def entity_shards(df: DataFrame, entity: Column, at: str) -> int:
    """About how many trees a table makes: one scan of two columns, no shuffle of rows."""
    shard = F.floor(F.unix_date(F.to_date(at)) / LEAVES)
    return df.agg(F.approx_count_distinct(F.xxhash64(entity, shard), 0.05)).first()[0]


def tree_table(days: DataFrame) -> DataFrame:
    """``(entity, shard, totals, rows)``: one tree per entity and 64 days with activity; node 1 is the root, 64..127 the days.

    ``days`` comes from :func:`daily`; several rows of one day (corrections) add up.
    """
    packed = days.groupBy("entity", F.floor(F.col("day") / LEAVES).cast("int").alias("shard")).agg(
        F.collect_list(F.struct(F.col("day").cast("int"), F.col("total").cast("long"), F.col("n_rows").cast("long"))).alias("days")
    )
    schema = T.StructType(
        [
            days.schema["entity"],
            T.StructField("shard", T.IntegerType()),
            T.StructField("totals", T.ArrayType(T.LongType())), T.StructField("rows", T.ArrayType(T.LongType())),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("days")
            n, flat = len(lists), lists.flatten()
            tree = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            nodes = build_trees(tree, n, *(flat.field(k).to_numpy() for k in range(3)))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * 2 * LEAVES)
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in nodes]
            yield pa.RecordBatch.from_arrays([batch.column("entity"), batch.column("shard"), *arrays], names=["entity", "shard", "totals", "rows"])

    return packed.mapInArrow(build, schema)


def correct_trees(trees: DataFrame, corrections: DataFrame) -> DataFrame:
    """Adds late ``corrections`` ``(entity, day, total, n_rows)`` (signed) to the nodes above their days.

    A correction changes the seven nodes from its leaf to its root; trees without one pass unchanged.
    """
    keys = ["entity", "shard"]
    delta = tree_table(corrections)
    added = delta.withColumnsRenamed({"totals": "__t", "rows": "__r"})
    plus = lambda c, d: F.when(F.col(d).isNull(), F.col(c)).otherwise(F.zip_with(c, d, lambda x, y: x + y)).alias(c)
    touched = trees.join(added, keys, "left").select(*keys, plus("totals", "__t"), plus("rows", "__r"))
    return touched.unionByName(delta.join(trees.select(*keys), keys, "left_anti"))


def write_trees(trees: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stores trees in one directory per shard of 64 days; only the shards that ``trees`` holds are replaced."""
    trees.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def correct_stored(spark: SparkSession, path: str, corrections: DataFrame) -> None:
    """Applies corrections to stored trees: reads and rewrites the shards (at most one per 64 days) they touch."""
    shard = F.floor(F.col("day") / LEAVES).cast("int")
    touched = [r[0] for r in corrections.select(shard.alias("s")).distinct().collect()]
    stored = spark.read.parquet(path)
    trees = stored.where(F.col("shard").isin(touched)).select("entity", "shard", "totals", "rows")
    write_trees(cut(correct_trees(trees, corrections)), path)


def answer(
    trees: DataFrame,
    windows: Sequence[int] = (7, 30),
    gaps_rising: tuple[int, int] | None = None,
    trees_per_group: int = 10_000,
    expected: int | None = None,
) -> DataFrame:
    """``(entity, day, n_rows, total_<w>...)`` for every day from an entity's first active one to its last, from stored trees.

    Totals are exact ints.  With ``gaps_rising=(a, b)`` only days without activity come out on which
    ``total_a / a > total_b / b``.  No trees give no rows.  ``expected`` is the rough number of trees if
    the caller knows it (:func:`entity_shards`); it sets the number of groups only.
    """
    n = expected if expected is not None else trees.count()
    groups = max(int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // trees_per_group))
    cols = [f"total_{w}" for w in windows]
    fields = [T.StructField("day", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("n_rows", *cols))]
    schema = T.StructType([trees.schema["entity"], *fields])

    def block(code: np.ndarray, shard: np.ndarray, sums: np.ndarray, counts: np.ndarray, names: pa.Array) -> pa.Table:
        forest = Forest(code, shard, sums, counts)
        entity, date = forest.dates()
        active = forest.active(entity, date)
        if gaps_rising:
            gap = active == 0
            entity, date, active = entity[gap], date[gap], active[gap]
        totals = {w: forest.window(entity, date, w) for w in windows}
        if gaps_rising:
            a, b = gaps_rising
            rising = totals[a] * b > totals[b] * a
            entity, date, active = entity[rising], date[rising], active[rising]
            totals = {w: x[rising] for w, x in totals.items()}
        arrays = [names.take(pa.array(entity)), pa.array(date.astype(np.int32)), pa.array(active), *(pa.array(totals[w]) for w in windows)]
        return pa.table(arrays, names=["entity", "day", "n_rows", *cols])

    def query(table: pa.Table) -> pa.Table:
        coded = table.column("entity").combine_chunks().dictionary_encode()
        code, shard = coded.indices.to_numpy().astype(np.int64), table.column("shard").to_numpy().astype(np.int64)
        order = np.lexsort((shard, code))
        code, shard = code[order], shard[order]
        sums, counts = (
            table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, 2 * LEAVES)[order] for c in ("totals", "rows")
        )
        first = np.searchsorted(code, np.arange(len(coded.dictionary) + 1))
        span = (shard[first[1:] - 1] - shard[first[:-1]] + 1) * LEAVES
        part = np.cumsum(span) // DATES_AT_ONCE  # a few entities at a time, however long their courses
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(span)]
        return pa.concat_tables(
            block(code[first[a] : first[b]] - a, *(x[first[a] : first[b]] for x in (shard, sums, counts)), coded.dictionary[a:b])
            for a, b in zip(cuts, cuts[1:], strict=False)
            if b > a
        )

    grouped = trees.withColumn("__group", F.pmod(F.xxhash64("entity"), F.lit(groups))).groupBy("__group")
    return grouped.applyInArrow(query, schema)


def trailing_totals(
    days: DataFrame, windows: Sequence[int] = (7, 30), gaps_rising: tuple[int, int] | None = None, expected: int | None = None
) -> DataFrame:
    """:func:`answer` over the trees of ``days``."""
    return answer(tree_table(days), windows, gaps_rising, expected=expected)
