"""Sources over fake clients, decoders, sinks, resuming, interpolation and streams."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from augury.functions.blocks import interpolate, iso_z
from augury.functions.distributions import incomplete_beta, normal_upper, t_two_sided
from augury.sources import archive, clients, decode, ingest, paged, schemas, sinks, tables
from augury.streaming import incremental

FILLS = "block_number long, transaction_hash string, log_index long, maker_amount long, _fetched_at timestamp_ntz"


def make_fetch(most: int, fail_at: int | None = None):
    def fetch(low: int, high: int):
        from augury.sources.paged import TooLarge

        if high - low + 1 > most:
            raise TooLarge
        if fail_at is not None and low <= fail_at <= high:
            raise RuntimeError("interrupted")
        return [(b, f"0x{b:x}", 0, b * 10, datetime(2024, 1, 1)) for b in range(low, high + 1, 100)]

    return fetch


def test_ranges_cover_once():
    assert paged.block_ranges(1000, 3500, 1000) == [(1000, 1999), (2000, 2999), (3000, 3500)]
    assert paged.block_ranges(5, 4, 10) == [] and paged.block_ranges(7, 7, 10) == [(7, 7)]


def test_split_and_errors():
    rows = list(paged.logs_between(make_fetch(64), 0, 999))
    assert {r[0] for r in rows} >= {0} and len({r[0] for r in rows}) == len(rows)
    with pytest.raises(RuntimeError):
        list(paged.logs_between(make_fetch(10_000, 50), 0, 99))
    with pytest.raises(paged.TooLarge):
        list(paged.logs_between(make_fetch(0), 5, 5))


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise paged.Retry("busy", 429)
        return "ok"

    assert paged.with_retries(call, sleep=waits.append) == "ok" and waits == [1, 2, 4]
    with pytest.raises(paged.Retry):
        paged.with_retries(lambda: (_ for _ in ()).throw(paged.Retry("no", 404)), sleep=waits.append)


def test_pages():
    data = [(k,) for k in range(23)]
    by_cursor = lambda c: (data[int(c or 0) : int(c or 0) + 10], str(int(c or 0) + 10) if int(c or 0) + 10 < 23 else None)
    assert list(paged.cursor_pages(by_cursor)) == data
    assert list(paged.offset_pages(lambda at, n: data[at : at + n], 10)) == data and list(paged.offset_pages(lambda at, n: [], 10)) == []


def test_log_source_batch_and_stream(spark, tmp_path):
    def fetch(low, high):
        return [(b, f"0x{b:x}", 0, b * 10, datetime(2024, 1, 1)) for b in range(low, high + 1) if b % 100 == 0]

    def head():
        return 5000

    paged.register_logs(spark, "fake_logs", FILLS, fetch, head)
    batch = spark.read.format("fake_logs").option("from", "1000").load()
    assert batch.rdd.getNumPartitions() == 5 and batch.count() == 41
    stream = spark.readStream.format("fake_logs").option("from", "1000").load()
    out = str(tmp_path / "fills")
    for _ in range(2):  # the second run starts from the checkpoint and adds nothing
        incremental.append_stream(
            stream.withColumn("key", F.concat_ws(":", "transaction_hash", "log_index")), out, "key", str(tmp_path / "cp")
        ).awaitTermination()
        assert spark.read.parquet(out).count() == 41


def test_keyed_and_offset_sources(spark):
    data = [(k,) for k in range(23)]
    paged.register_keyed(spark, "fake_keyed", "ticker string, n int", ["A", "B"], lambda key, c: ([(key, 1), (key, 2)], None))
    assert sorted(map(tuple, spark.read.format("fake_keyed").load().collect())) == [("A", 1), ("A", 2), ("B", 1), ("B", 2)]
    for total in (None, 23):
        paged.register_offsets(spark, "fake_offsets", "n int", lambda at, n: data[at : at + n], size=5, pages_per_part=2, total=total)
        assert sorted(r["n"] for r in spark.read.format("fake_offsets").load().collect()) == list(range(23))


def test_decoders(spark):
    raw = [
        {
            "trade_id": "t",
            "ticker": "A",
            "count_fp": "3.00",
            "yes_price_dollars": "0.2900",
            "no_price_dollars": "0.7100",
            "created_time": "2024-01-01T05:00:00Z"
        },
        {"trade_id": "u", "ticker": "B", "count": 2, "yes_price": 57, "no_price": 43, "taker_side": "yes", "created_time": "bad"}
    ]
    got = decode.k_trades(spark.createDataFrame([(json.dumps(r),) for r in raw] + [(None,)], "payload string")).collect()
    assert [tuple(r)[:6] for r in got] == [("t", "A", 3, 29, 71, ""), ("u", "B", 2, 57, 43, "yes")]
    assert got[0]["created_time"] == datetime(2024, 1, 1, 5) and got[1]["created_time"] is None
    dollars = spark.createDataFrame([(f"{c / 100:.2f}", c) for c in range(100)], "d string, c int")
    assert dollars.where(decode.cents(F.col("d")) != F.col("c")).count() == 0
    m = decode.k_markets(
        spark.createDataFrame([(json.dumps({"ticker": "A", "status": "open", "yes_bid": 5, "volume": 7}),)], "payload string")
    ).first()
    assert (m["yes_bid"], m["volume"], m["result"], m["close_time"]) == (5, 7, "", None)
    p = decode.p_markets(
        spark.createDataFrame(
            [(json.dumps({"id": "1", "outcomePrices": '["1","0"]', "volume": "2.5", "closed": True, "endDate": ""}),)], "payload string"
        )
    ).first()
    assert (p["outcome_prices"], p["volume"], p["closed"], p["end_date"]) == ('["1","0"]', 2.5, True, None)


def test_log_decoders(spark):
    word = lambda n: f"{n:064x}"
    topics = ["0x" + word(k) for k in (1, 2, 0xAB, 0xCD)]
    data = "0x" + "".join(map(word, (0, 2**255, 5, 7, 1)))
    rows = [
        (1, "0xt", 2, "0xc", topics, data), (2, "0xt", 3, "0xc", topics[:2], "0x"), (2, "0xt", 4, "0xc", topics, data[:-1]),
        (2, "0xt", 5, "0xc", topics, data.replace("0x", "zz")), (2, "0xt", 6, "0xc", None, None), (2, None, 7, "0xc", topics, data),
    ]
    logs = spark.createDataFrame(rows, decode.LOG)
    [row] = decode.fills(logs).collect()
    assert (
        row["order_hash"], row["maker"], row["taker_asset_id"], row["maker_amount"], row["fee"]
    ) == (topics[1], "0x" + f"{0xAB:040x}", str(2**255), "5", "1")
    assert decode.undecodable(logs).count() == 5 and decode.undecodable(logs.limit(0)).count() == 0
    amm = [decode.topic_of(decode.BUY_EVENT), decode.topic_of(decode.SELL_EVENT), "0x" + word(77)]
    rows = [(k, "0xt", k, "0xFF", [t, "0x" + word(9), "0x" + word(1)], "0x" + "".join(map(word, (10, 2, 2**200)))) for k, t in enumerate(amm)]
    got = sorted(map(tuple, decode.amm_trades(spark.createDataFrame(rows, decode.LOG)).collect()))
    assert got == [(k, "0xt", k, "0xff", "0x" + f"{9:040x}", "10", "2", 1, str(2**200), k == 0) for k in (0, 1)]
    assert decode.asset_hex("255") == word(255) and decode.asset_hex("x") is None and decode.asset_hex(str(2**256)) is None


def test_event_topics():
    """Known hashes: of nothing, and of the transfer event."""
    assert decode.keccak256(b"") == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert decode.topic_of("Transfer(address,address,uint256)") == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert len(decode.keccak256(b"x" * 1000)) == 64


class Chain:
    """A node with blocks of two seconds and a fill every hundredth block."""

    def __init__(self, head: int, broken: int | None = None):
        self.top, self.broken = head, broken

    def head(self):
        return self.top

    def block_time(self, block):
        return 1_700_000_000 + 2 * block

    def logs(self, low, high, topics, address=None):
        if self.broken is not None and low <= self.broken <= high:
            raise RuntimeError("interrupted")
        word = lambda n: f"{n:064x}"
        amm = isinstance(topics[0], list)
        out = []
        for b in range(-(-low // 100) * 100, high + 1, 100):
            full = ["0x" + word(k) for k in (1, 2, 3, 4)]
            full[0] = topics[0][b // 100 % 2] if amm else topics[0]
            out.append((b, f"0x{b:064x}", 0, "0xC", full, "0x" + "".join(map(word, (b, 1, 2, 3, 4)))))
        return out


def test_ingest_jobs(spark, tmp_path):
    """An interrupted job leaves what was stored; started again it goes on and stores nothing twice."""
    folder, jobs = str(tmp_path), ingest.jobs()
    assert {"fills", "amm_trades", "blocks", "k_markets", "k_trades", "p_markets"} == set(jobs)
    jobs["fills"].run(spark, Chain(2999), folder)
    with pytest.raises(Exception, match="interrupted"):
        jobs["fills"].run(spark, Chain(5000, broken=4000), folder)
    assert spark.read.parquet(f"{folder}/fills.parquet").count() == 30
    for _ in range(2):
        jobs["fills"].run(spark, Chain(5000), folder)
    rows = spark.read.parquet(f"{folder}/fills.parquet")
    assert rows.count() == 51 and rows.select("fill_key").distinct().count() == 51 and rows.agg(F.max("block_number")).first()[0] == 5000
    jobs["amm_trades"].run(spark, Chain(999), folder)
    assert {r["is_buy"]: r["count"] for r in spark.read.parquet(f"{folder}/amm_trades.parquet").groupBy("is_buy").count().collect()} == {True: 5, False: 5}
    jobs["blocks"].run(spark, Chain(250_123), folder)
    jobs["blocks"].run(spark, Chain(250_400), folder)
    times = spark.read.parquet(f"{folder}/blocks.parquet")
    assert times.count() == times.select("block_number").distinct().count() == 250_401
    assert times.where("block_number = 250123").first()["timestamp"] == "2023-11-20T17:10:46Z"
    assert ingest.first_block(spark, f"{folder}/none", 2_345_678) == 1_300_000
    with pytest.raises(ValueError, match="1 logs"):
        ingest.complete_or_fail(spark.createDataFrame([(1, "0x", 1, "0xc", [], "0x")], decode.LOG), 4, 5)


def test_sampled_blocks():
    assert list(ingest.sampled_blocks(95, 412, 100, 200)) == [95, 195, 199, 200, 300, 399, 400, 412]
    assert list(ingest.sampled_blocks(7, 7)) == [7] and list(ingest.sampled_blocks(8, 7)) == []


class Venue:
    def markets(self, cursor=None, **_):
        yield ([{"ticker": "A", "volume": 500}, {"ticker": "B", "volume": 5}], "next") if cursor is None else ([{"ticker": "C", "volume": 200}], None)

    def cursor_pages(self, path, field, limit, cursor=None, ticker=None):
        yield [{"trade_id": f"{ticker}{k}", "ticker": ticker, "count": 1, "yes_price": 40, "no_price": 60} for k in range(3)], None

    def offset_page(self, path, offset, limit):
        return [{"id": str(k), "outcomePrices": "[]"} for k in range(offset, min(offset + limit, 700))]


def test_ingest_of_payloads(spark, tmp_path):
    folder, jobs = str(tmp_path), ingest.jobs()
    for _ in range(2):
        for name in ("k_markets", "k_trades", "p_markets"):
            jobs[name].run(spark, Venue(), folder)
    count = lambda n: spark.read.parquet(f"{folder}/{n}.parquet").count()
    assert (count("k_markets"), count("k_trades"), count("p_markets")) == (3, 6, 700)


def test_clients(monkeypatch):
    """Retries on busy replies and broken connections, cursors, time bounds, lists in objects, ranges that are too large."""
    import io
    import urllib.error
    from urllib.parse import parse_qs, urlparse

    asked, busy = [], [urllib.error.HTTPError("u", 503, "busy", {}, None), urllib.error.URLError("down")]

    def urlopen(call, timeout):
        if busy:
            raise busy.pop()
        q = parse_qs(urlparse(call.full_url).query)
        asked.append(q)
        if call.data:
            body = json.loads(call.data)
            reply = {"result": hex(77)} if body["method"] == "eth_blockNumber" else {"error": {"message": "query returned more than 10000 results"}}
        elif "offset" in q:
            reply = {"data": [{"id": 1}]}
        else:
            reply = {"trades": [{"trade_id": len(asked)}], "cursor": "c" if "cursor" not in q else ""}
        return io.BytesIO(json.dumps(reply).encode())

    monkeypatch.setattr("urllib.request.urlopen", urlopen)
    monkeypatch.setattr("augury.sources.paged.time.sleep", lambda _: None)
    monkeypatch.setattr(paged.with_retries, "__defaults__", (5, 0.0, 0.0, lambda _: None))
    rest = clients.Rest("http://venue")
    assert len(list(rest.trades("A B", since=5))) == 2 and asked[0] == {"limit": ["1000"], "ticker": ["A B"], "min_ts": ["5"]}
    assert asked[1]["cursor"] == ["c"] and rest.offset_page("markets", 500) == [{"id": 1}]
    rpc = clients.Rpc("http://node")
    assert rpc.head() == 77
    with pytest.raises(paged.TooLarge):
        rpc.logs(1, 2, [])
    busy.append(urllib.error.HTTPError("u", 404, "no", {}, None))
    with pytest.raises(paged.Retry):
        rest.get("markets/x")


def test_chunks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    df = lambda *ids: spark.createDataFrame([(i, i * 2, datetime(2024, 1, 1)) for i in ids], "id long, v long, _fetched_at timestamp_ntz")
    assert sinks.next_chunk(spark, path, 10) == 0
    sinks.append_chunks(df(*range(14)), path, "id", rows=10)
    full = sorted(p.name for p in (tmp_path / "chunks" / "chunk=0").glob("*.parquet"))
    sinks.append_chunks(df(*range(5, 37), 36), path, "id", rows=10)
    sinks.append_chunks(df(3, 4), path, "id", rows=10)
    stored = spark.read.parquet(path)
    assert {r["chunk"]: r["count"] for r in stored.groupBy("chunk").count().collect()} == {0: 10, 10: 10, 20: 10, 30: 7}
    assert stored.select("id").distinct().count() == 37 and sinks.next_chunk(spark, path, 10) == 40
    assert sorted(p.name for p in (tmp_path / "chunks" / "chunk=0").glob("*.parquet")) == full


def test_batches_come_again(spark, tmp_path):
    """A batch that runs twice stores its rows once, with and without a key."""
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame([(k, v, datetime(2024, 1, 1)) for k, v in r], "id string, v int, _fetched_at timestamp_ntz")
    for n, batch in ((0, df(("a", 1), (None, 2))), (1, df(("a", 3), ("b", 4), (None, 5))), (1, df(("a", 3), ("b", 4), (None, 5)))):
        sinks.append_batch(batch, n, path, "id")
    assert sorted((r["id"] or "", r["v"]) for r in spark.read.parquet(path).collect()) == [("", 2), ("", 5), ("a", 1), ("b", 4)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame([(k, v, datetime(2024, 1, v)) for k, v in r], "id string, v int, _fetched_at timestamp_ntz")
    sinks.append_new(df(("a", 2), ("a", 1), (None, 3)), path, "id")
    sinks.append_new(df(("a", 5), ("b", 6), ("b", 7)), path, "id", rows_per_file=1)
    assert sorted((r["id"] or "", r["v"]) for r in spark.read.parquet(path).collect()) == [("", 3), ("a", 1), ("b", 6)]
    blocks = str(tmp_path / "blocks")
    assert sinks.next_block(spark, blocks, 7) == 7
    sinks.write_blocks(spark.range(99_990, 100_010).select(F.col("id").alias("block_number"), F.lit("x").alias("timestamp")), blocks)
    assert sinks.next_block(spark, blocks) == 100_010 and {
        r["part"] for r in spark.read.parquet(blocks).select("part").distinct().collect()
    } == {0, 1}
    lookup = tmp_path / "lookup.json"
    lookup.write_text(json.dumps({"0xA": {"collateral_symbol": "USDC", "collateral_decimals": 6}, "0xB": {}}))
    assert sorted(map(tuple, sinks.read_lookup(spark, str(lookup)).collect())) == [("0xA", "USDC", 6), ("0xB", None, None)]
    markets = spark.createDataFrame([("A", 500), ("B", 50), ("C", 100)], "ticker string, volume long")
    assert [r[0] for r in sinks.tickers_to_fetch(markets, spark.createDataFrame([("A",)], "ticker string")).collect()] == ["C"]


def test_conform_and_optional(spark, tmp_path):
    df = spark.createDataFrame([("A", 1)], "ticker string, volume int")
    got = schemas.conform(df, schemas.K_MARKETS, ("ticker",))
    assert got.schema.fieldNames() == schemas.K_MARKETS.fieldNames() and got.first()["result"] is None
    with pytest.raises(ValueError, match="ticker"):
        schemas.conform(df.drop("ticker"), schemas.K_MARKETS, ("ticker",))
    assert tables.optional_table(spark, str(tmp_path), "none", schemas.P_BLOCKS).count() == 0


def test_interpolation(spark):
    samples = [(0, 1000), (100, 1250), (100, 1250), (135, 1300), (4000, 9000)]
    for size in (50, 1000, 10_000_000):
        got = {
            r[0]: r[1] for r in interpolate(spark.createDataFrame(samples, "block_number long, seconds long"), slice_blocks=size).collect()
        }
        assert len(got) == 4001 and got[0] == 1000 and got[1] == 1002 and got[99] == 1247 and got[135] == 1300 and got[4000] == 9000
    assert spark.createDataFrame([(1704067200,)], "s long").select(iso_z("s")).first()[0] == "2024-01-01T00:00:00Z"
    assert interpolate(spark.createDataFrame([], "block_number long, seconds long")).count() == 0


def test_streams(spark, small, tmp_path):
    stream = tables.stream_table(spark, small, "events")
    daily = stream.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    got = incremental.run_to_memory(daily, "days", checkpoint=str(tmp_path / "c1"))
    want = spark.read.parquet(f"{small}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    once = incremental.drop_repeats(
        tables.stream_table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], "ts", "60 days"
    )
    kept = incremental.run_to_memory(once.select("event_id"), "once", "append", str(tmp_path / "c2"))
    assert kept.count() == spark.read.parquet(f"{small}/events.parquet").select("event_id").distinct().count()
    volume = incremental.windowed_volume(
        tables.stream_table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_id"
    )
    assert incremental.run_to_memory(volume, "volume").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_distributions():
    assert normal_upper(1.959963985) == pytest.approx(0.025, abs=1e-9) and t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert t_two_sided(1.96, 1e7) == pytest.approx(0.05, abs=1e-4) and incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875) and incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)


def test_archive_and_prefix(spark, tmp_path):
    src = tmp_path / "data"
    src.mkdir()
    for n in ("trades_0_10", "trades_10_20", "markets_0_10"):
        spark.range(5).toPandas().to_parquet(src / f"{n}.parquet")
    assert tables.prefixed(spark, str(src), "trades_").count() == 10 and tables.prefixed(
        spark, str(src), "markets_", spark.range(1).schema
    ).count() == 5
    for name in ("a.tar.zst", "a.tar.gz"):
        out = archive.unpack(archive.pack(src, tmp_path / name), tmp_path / f"out_{name}")
        assert sorted(p.name for p in (out / "data").iterdir()) == sorted(p.name for p in src.iterdir())
