"""Named ingest jobs: what to fetch, where to go on, how to store it.

A job takes the session, a client and the folder of tables.  Requests run as tasks of the sources in
:mod:`augury.sources.paged`; every job resumes from what the table holds, so an interrupted run is simply
started again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions.blocks import interpolate, iso_z
from augury.sources import decode, paged, sinks
from augury.sources.tables import exists

# Blocks per request, distance of sampled block headers, parts that a first run reaches back.
BLOCKS_PER_REQUEST, SAMPLE_STEP, PARTS_BACK = 1000, 100, 10


class Node(Protocol):
    """What the block and log jobs need of a client (:class:`augury.sources.clients.Rpc` is one)."""

    def head(self) -> int: ...

    def block_time(self, block: int) -> int: ...

    def logs(self, low: int, high: int, topics: list[Any], address: str | None = None) -> list[tuple]: ...


@dataclass(frozen=True)
class Ingest:
    """A named job; ``run`` stores what is new."""

    name: str
    description: str
    run: Callable[[SparkSession, Any, str], None]


_known: dict[str, Ingest] = {}


def ingest(name: str, description: str) -> Callable:
    """Registers a job under a name."""

    def add(run: Callable[[SparkSession, Any, str], None]) -> Callable[[SparkSession, Any, str], None]:
        _known[name] = Ingest(name, description, run)
        return run

    return add


def jobs() -> dict[str, Ingest]:
    return dict(_known)


def sampled_blocks(low: int, high: int, step: int = SAMPLE_STEP, size: int = sinks.BLOCKS_PER_PART) -> Iterator[int]:
    """Every ``step``-th block of each part of ``size`` blocks, and the last of each part, from ``low`` to ``high``."""
    while low <= high:
        end = min((low // size + 1) * size - 1, high)
        yield from range(low, end, step)
        yield end
        low = end + 1


def register_headers(spark: SparkSession, name: str, time_of: Callable[[int], int], blocks_per_task: int = 100) -> None:
    """Registers a source of ``(block_number, seconds)`` of sampled headers; options ``from``, ``to`` and ``step``.

    A header that can't be read after retries fails its task: no sample is skipped.
    """

    class Reader(paged.DataSourceReader):
        def __init__(self, options: dict[str, str]):
            low, high, step = int(options["from"]), int(options["to"]), int(options.get("step", SAMPLE_STEP))
            self.blocks = list(sampled_blocks(low, high, step))

        def partitions(self) -> list[paged.Part]:
            return [paged.Part(low=a, high=min(a + blocks_per_task, len(self.blocks))) for a in range(0, len(self.blocks), blocks_per_task)]

        def read(self, partition: paged.Part) -> Iterator[tuple]:
            for b in self.blocks[partition.low : partition.high]:
                yield b, paged.with_retries(lambda b=b: time_of(b))

    class Headers(paged.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "block_number long, seconds long"

        def reader(self, schema: Any) -> Reader:
            return Reader(dict(self.options))

    spark.dataSource.register(Headers)


def first_block(spark: SparkSession, path: str, head: int, size: int = sinks.BLOCKS_PER_PART) -> int:
    """Where block times go on: after the last stored block, for a new table ``PARTS_BACK`` whole parts before the head's part."""
    return sinks.next_block(spark, path, max(0, head // size * size - size * PARTS_BACK))


def complete_or_fail(logs: DataFrame, topics: int, words: int) -> DataFrame:
    """The logs, if all of them can be decoded: a log that can't stops the job instead of leaving a gap."""
    bad = decode.undecodable(logs, topics, words).count()
    if bad:
        raise ValueError(f"{bad} logs can't be decoded")
    return logs


def _store_logs(spark: SparkSession, client: Node, path: str, topics: list[Any], decoded: Callable[[DataFrame], DataFrame], need: tuple[int, int]) -> None:
    source = f"augury_logs_{need[0]}_{need[1]}"
    paged.register_logs(spark, source, decode.LOG, lambda a, b: client.logs(a, b, topics), client.head)
    options = {"from": sinks.next_block(spark, path, 0), "to": client.head(), "blocks_per_range": BLOCKS_PER_REQUEST}
    if options["from"] > options["to"]:
        return
    logs = sinks.cut(spark.read.format(source).options(**options).load())
    rows = decoded(complete_or_fail(logs, *need)).withColumn("_fetched_at", F.localtimestamp())
    key = F.concat_ws(":", "transaction_hash", "log_index")
    sinks.append_new(rows.withColumn("fill_key", key), path, "fill_key")


@ingest("fills", "Order-book fills from the event log")
def fills(spark: SparkSession, client: Node, folder: str) -> None:
    _store_logs(spark, client, f"{folder}/fills.parquet", [decode.topic_of(decode.FILL_EVENT)], decode.fills, (4, 5))


@ingest("amm_trades", "Buys and sells of market makers from the event log")
def amm_trades(spark: SparkSession, client: Node, folder: str) -> None:
    either = [[decode.topic_of(decode.BUY_EVENT), decode.topic_of(decode.SELL_EVENT)]]
    _store_logs(spark, client, f"{folder}/amm_trades.parquet", either, decode.amm_trades, (3, 3))


@ingest("blocks", "A time for every block, from sampled headers")
def blocks(spark: SparkSession, client: Node, folder: str) -> None:
    """Samples are read from the last stored block on, so the course between stored and new blocks has no gap."""
    path, head = f"{folder}/blocks.parquet", client.head()
    start = first_block(spark, path, head)
    if start > head:
        return
    register_headers(spark, "augury_headers", client.block_time)
    samples = spark.read.format("augury_headers").options(**{"from": start, "to": head}).load()
    times = interpolate(samples).select("block_number", iso_z("seconds").alias("timestamp"))
    sinks.write_blocks(times, path)


def _store_payloads(spark: SparkSession, payloads: DataFrame, decoded: Callable[[DataFrame], DataFrame], path: str, key: str) -> None:
    sinks.append_new(decoded(payloads).withColumn("_fetched_at", F.localtimestamp()), path, key)


def _register_json(spark: SparkSession, name: str, keys: Sequence[str], pages: Callable[[str, str | None], tuple[Sequence[dict], str | None]]) -> DataFrame:
    import json

    def page(key: str, cursor: str | None) -> tuple[list[tuple], str | None]:
        rows, after = pages(key, cursor)
        return [(json.dumps(r),) for r in rows], after

    paged.register_keyed(spark, name, "payload string", keys, page)
    return spark.read.format(name).load()


@ingest("k_markets", "Markets of the order-book venue")
def k_markets(spark: SparkSession, client: Any, folder: str) -> None:
    raw = _register_json(spark, "augury_k_markets", ["all"], lambda _, c: next(client.markets(cursor=c)))
    _store_payloads(spark, raw, decode.k_markets, f"{folder}/k_markets.parquet", "ticker")


@ingest("k_trades", "Trades of the order-book venue, one task per ticker that has none stored")
def k_trades(spark: SparkSession, client: Any, folder: str) -> None:
    path = f"{folder}/k_trades.parquet"
    markets = spark.read.parquet(f"{folder}/k_markets.parquet")
    stored = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], "ticker string")
    tickers = [r[0] for r in sinks.tickers_to_fetch(markets, stored).orderBy("ticker").toLocalIterator()]
    raw = _register_json(spark, "augury_k_trades", tickers, lambda k, c: next(client.cursor_pages("markets/trades", "trades", 1000, c, ticker=k)))
    if tickers:
        _store_payloads(spark, raw, decode.k_trades, path, "trade_id")


@ingest("p_markets", "Markets of the on-chain venue, by offset")
def p_markets(spark: SparkSession, client: Any, folder: str) -> None:
    import json

    paged.register_offsets(spark, "augury_p_markets", "payload string", lambda at, n: [(json.dumps(r),) for r in client.offset_page("markets", at, n)])
    _store_payloads(spark, spark.read.format("augury_p_markets").load(), decode.p_markets, f"{folder}/p_markets.parquet", "id")
