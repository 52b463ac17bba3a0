"""Paged REST and event-log sources as Spark data sources, over any client.

The client is a Python object that the driver hands over; it does the requests.  One input partition
covers one ticker, one range of pages or one range of blocks, so requests run as tasks, and Spark's task
retries take the place of a thread pool.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Replies that are worth another try.
RETRIED_STATUS = (429, 500, 502, 503, 504)


class Retry(Exception):
    """A request may succeed later; ``status`` is the HTTP status if there was a reply."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class TooLarge(Exception):
    """A range holds more events than the endpoint gives at once."""


def with_retries(
    call: Callable[[], Any], attempts: int = 5, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep
) -> Any:
    """Calls again after ``Retry`` with doubled waits; other statuses and the last failure are raised."""
    for n in range(attempts):
        try:
            return call()
        except Retry as e:
            if n + 1 == attempts or (e.status is not None and e.status not in RETRIED_STATUS):
                raise
            sleep(min(most, first * 2**n))
    return None


@dataclass
class Part(InputPartition):
    """One unit of reading: a key, or an inclusive range."""

    key: str | None = None
    low: int = 0
    high: int = 0


def cursor_pages(page: Callable[[str | None], tuple[Sequence[tuple], str | None]]) -> Iterator[tuple]:
    """All rows of an endpoint that hands out the next cursor; ends at an empty page or cursor."""
    cursor = None
    while True:
        rows, cursor = with_retries(lambda c=cursor: page(c))
        yield from rows
        if not rows or not cursor:
            return


def offset_pages(page: Callable[[int, int], Sequence[tuple]], size: int, start: int = 0) -> Iterator[tuple]:
    """All rows of an endpoint by offset; ends at a short page."""
    while True:
        rows = with_retries(lambda at=start: page(at, size))
        yield from rows
        if len(rows) < size:
            return
        start += size


def block_ranges(low: int, high: int, size: int) -> list[tuple[int, int]]:
    """Inclusive ranges of at most ``size`` blocks that cover ``low..high`` once."""
    return [(a, min(a + size - 1, high)) for a in range(low, high + 1, size)]


def logs_between(fetch: Callable[[int, int], Sequence[tuple]], low: int, high: int) -> Iterator[tuple]:
    """Events of a block range; a range that is too large is halved until it fits.

    Other errors are raised: a range is read whole or not at all, so there are no silent gaps.
    """
    try:
        yield from with_retries(lambda: fetch(low, high))
    except TooLarge:
        if low >= high:
            raise
        middle = (low + high) // 2
        yield from logs_between(fetch, low, middle)
        yield from logs_between(fetch, middle + 1, high)


def register_logs(
    spark: SparkSession, name: str, schema: str, fetch: Callable[[int, int], Sequence[tuple]], head: Callable[[], int]
) -> None:
    """Registers an event-log source: ``spark.read`` and ``spark.readStream`` with format ``name``.

    Options: ``from``, ``to`` (batch; the head by default), ``blocks_per_range``.  Stream offsets are
    block numbers, kept by Spark's checkpoint.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.low, self.size = int(options.get("from", 0)), int(options.get("blocks_per_range", 1000))
            self.high = int(options["to"]) if "to" in options else head()

        def partitions(self) -> list[Part]:
            return [Part(low=a, high=b) for a, b in block_ranges(self.low, self.high, self.size)]

        def read(self, partition: Part) -> Iterator[tuple]:
            yield from logs_between(fetch, partition.low, partition.high)

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.low, self.size = int(options.get("from", 0)), int(options.get("blocks_per_range", 1000))

        def initialOffset(self) -> dict:
            return {"block": self.low}

        def latestOffset(self) -> dict:
            return {"block": head() + 1}

        def partitions(self, start: dict, end: dict) -> list[Part]:
            return [Part(low=a, high=b) for a, b in block_ranges(start["block"], end["block"] - 1, self.size)]

        def read(self, partition: Part) -> Iterator[tuple]:
            yield from logs_between(fetch, partition.low, partition.high)

        def commit(self, end: dict) -> None:
            pass

    class Logs(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: Any) -> Reader:
            return Reader(dict(self.options))

        def streamReader(self, schema: Any) -> Stream:
            return Stream(dict(self.options))

    spark.dataSource.register(Logs)


def register_keyed(
    spark: SparkSession, name: str, schema: str, keys: Sequence[str], page: Callable[[str, str | None], tuple[Sequence[tuple], str | None]]
) -> None:
    """Registers a cursor-paged source with one partition per key (a ticker, or one key for all rows)."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[Part]:
            return [Part(key=k) for k in keys] or [Part()]

        def read(self, partition: Part) -> Iterator[tuple]:
            if partition.key is not None:
                yield from cursor_pages(lambda c: page(partition.key, c))

    class Keyed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: Any) -> Reader:
            return Reader()

    spark.dataSource.register(Keyed)


def register_offsets(
    spark: SparkSession,
    name: str,
    schema: str,
    page: Callable[[int, int], Sequence[tuple]],
    size: int = 500,
    pages_per_part: int = 20,
    total: int | None = None
) -> None:
    """Registers an offset-paged source.

    With a known ``total`` its ranges are read in parallel; otherwise one partition reads to the end.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[Part]:
            if total is None:
                return [Part(low=0, high=-1)]
            step = size * pages_per_part
            return [Part(low=a, high=min(a + step, total)) for a in range(0, max(total, 1), step)]

        def read(self, partition: Part) -> Iterator[tuple]:
            if partition.high < 0:
                yield from offset_pages(page, size)
                return
            for at in range(partition.low, partition.high, size):
                yield from with_retries(lambda at=at: page(at, min(size, partition.high - at)))

    class Offsets(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: Any) -> Reader:
            return Reader()

    spark.dataSource.register(Offsets)
