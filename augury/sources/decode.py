"""Decoding of recorded API and event-log payloads into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.operators.units import hex_text

# Fields of the venues' public JSON payloads.
K_TRADE_JSON = "trade_id string, ticker string, count_fp string, count string, yes_price_dollars string, no_price_dollars string, yes_price int, no_price int, taker_side string, created_time string"
K_MARKET_JSON = (
    "ticker string, event_ticker string, market_type string, title string, yes_sub_title string, no_sub_title string, status string, yes_bid_dollars string, yes_ask_dollars string, no_bid_dollars string, "
    "no_ask_dollars string, last_price_dollars string, yes_bid int, yes_ask int, no_bid int, no_ask int, last_price int, volume_fp string, volume string, volume_24h_fp string, volume_24h string, open_interest_fp string, open_interest string, "
    "result string, created_time string, open_time string, close_time string"
)
P_MARKET_JSON = (
    "id string, conditionId string, question string, slug string, outcomes string, outcomePrices string, clobTokenIds string, volume string, liquidity string, active boolean, closed boolean, endDate string, createdAt string, marketMakerAddress string"
)


def cents(dollars: Column) -> Column:
    """Dollars as text to whole cents, exactly: decimal arithmetic, so 0.29 is 29; null if unreadable."""
    return F.floor(dollars.try_cast("decimal(20,6)") * 100).cast("int")


def whole(number: Column) -> Column:
    """A number text to a whole number, fraction cut; null if unreadable."""
    return number.try_cast("decimal(38,6)").try_cast("bigint")


def moment(text: Column) -> Column:
    """ISO 8601 to UTC clock time; null for blank and unreadable texts."""
    seconds = F.unix_micros(text.try_cast("timestamp")) / 1_000_000
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _price(name: str) -> Column:
    return F.coalesce(cents(F.col(f"j.{name}_dollars")), F.col(f"j.{name}")).alias(name)


def _count(name: str) -> Column:
    return F.coalesce(whole(F.col(f"j.{name}_fp")), whole(F.col(f"j.{name}")))


def k_trades(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Trades from JSON payloads; a missing side is blank, a missing count is 0."""
    j = raw.select(F.from_json(column, K_TRADE_JSON).alias("j")).where(F.col("j").isNotNull())
    return j.select(
        "j.trade_id",
        "j.ticker",
        F.coalesce(_count("count"), F.lit(0)).alias("count"),
        _price("yes_price"),
        _price("no_price"),
        F.coalesce("j.taker_side", F.lit("")).alias("taker_side"),
        moment(F.col("j.created_time")).alias("created_time")
    )


def k_markets(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Markets from JSON payloads; missing quotes and times stay null."""
    j = raw.select(F.from_json(column, K_MARKET_JSON).alias("j")).where(F.col("j").isNotNull())
    text = ["ticker", "event_ticker", "market_type", "title", "yes_sub_title", "no_sub_title", "status"]
    quotes = ["yes_bid", "yes_ask", "no_bid", "no_ask", "last_price"]
    return j.select(
        *(F.col(f"j.{c}") for c in text),
        *map(_price, quotes),
        *(F.coalesce(_count(c), F.lit(0)).alias(c) for c in ("volume", "volume_24h", "open_interest")),
        F.coalesce("j.result", F.lit("")).alias("result"),
        *(moment(F.col(f"j.{c}")).alias(c) for c in ("created_time", "open_time", "close_time")),
    )


def p_markets(raw: DataFrame, column: str = "payload") -> DataFrame:
    """On-chain markets from JSON payloads."""
    j = raw.select(F.from_json(column, P_MARKET_JSON).alias("j")).where(F.col("j").isNotNull())
    number = lambda c: F.coalesce(F.col(f"j.{c}").try_cast("double"), F.lit(0.0)).alias(c)
    return j.select(
        "j.id",
        F.col("j.conditionId").alias("condition_id"),
        "j.question",
        "j.slug",
        "j.outcomes",
        F.col("j.outcomePrices").alias("outcome_prices"),
        F.col("j.clobTokenIds").alias("clob_token_ids"),
        number("volume"),
        number("liquidity"),
        "j.active",
        "j.closed",
        moment(F.col("j.endDate")).alias("end_date"),
        moment(F.col("j.createdAt")).alias("created_at"),
        F.col("j.marketMakerAddress").alias("market_maker_address"),
    )


LOG = T.StructType(
    [
        T.StructField(n, k) for n, k in (
            ("block_number", T.LongType()),
            ("transaction_hash", T.StringType()),
            ("log_index", T.LongType()),
            ("address", T.StringType()),
            ("topics", T.ArrayType(T.StringType())),
            ("data", T.StringType())
        )
    ]
)
FILL = T.StructType(
    [
        T.StructField(n, T.LongType() if n in ("block_number", "log_index") else T.StringType()) for n in (
            "block_number",
            "transaction_hash",
            "log_index",
            "order_hash",
            "maker",
            "taker",
            "maker_asset_id",
            "taker_asset_id",
            "maker_amount",
            "taker_amount",
            "fee"
        )
    ]
)


AMM_TRADE = T.StructType(
    [
        *(T.StructField(n, k) for n, k in (("block_number", T.LongType()), ("transaction_hash", T.StringType()), ("log_index", T.LongType()))),
        *(T.StructField(n, T.StringType()) for n in ("fpmm_address", "trader", "amount", "fee_amount")),
        T.StructField("outcome_index", T.LongType()),
        T.StructField("outcome_tokens", T.StringType()),
        T.StructField("is_buy", T.BooleanType()),
    ]
)
# Signatures of the events.
FILL_EVENT = "OrderFilled(bytes32,address,address,uint256,uint256,uint256,uint256,uint256)"
BUY_EVENT, SELL_EVENT = (f"FPMM{side}(address,uint256,uint256,uint256,uint256)" for side in ("Buy", "Sell"))


def keccak256(data: bytes) -> str:
    """The hash of event signatures, as hexadecimal digits (the original padding, not that of SHA-3)."""
    mask, rate = (1 << 64) - 1, 136
    turn = lambda x, n: ((x << n % 64) | (x >> (64 - n % 64))) & mask if n % 64 else x
    rounds, lfsr = [], 1
    for _ in range(24):
        constant = 0
        for j in range(7):
            constant |= (lfsr & 1) << ((1 << j) - 1)
            lfsr = (lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)
        rounds.append(constant)
    block = bytearray(data + bytes(rate - len(data) % rate))
    block[len(data)] ^= 0x01
    block[-1] ^= 0x80
    lanes = [[0] * 5 for _ in range(5)]
    for start in range(0, len(block), rate):
        for k in range(rate // 8):
            lanes[k % 5][k // 5] ^= int.from_bytes(block[start + 8 * k : start + 8 * k + 8], "little")
        for constant in rounds:
            parity = [a ^ b ^ c ^ d ^ e for a, b, c, d, e in lanes]
            lanes = [[v ^ parity[x - 1] ^ turn(parity[(x + 1) % 5], 1) for v in lanes[x]] for x in range(5)]
            moved = [[0] * 5 for _ in range(5)]
            moved[0][0] = lanes[0][0]
            x, y = 1, 0
            for t in range(24):
                moved[y][(2 * x + 3 * y) % 5] = turn(lanes[x][y], (t + 1) * (t + 2) // 2)
                x, y = y, (2 * x + 3 * y) % 5
            lanes = [[moved[x][y] ^ (~moved[(x + 1) % 5][y] & moved[(x + 2) % 5][y] & mask) for y in range(5)] for x in range(5)]
            lanes[0][0] ^= constant
    return b"".join(lanes[x][0].to_bytes(8, "little") for x in range(4)).hex()


def topic_of(signature: str) -> str:
    """The first topic of an event's logs."""
    return "0x" + keccak256(signature.encode())


def _digits(c: Column) -> Column:
    """Hexadecimal digits in lower case without a prefix; null for anything else."""
    plain = F.regexp_replace(F.lower(c), "^0x", "")
    return F.when(plain.rlike("^[0-9a-f]*$"), plain)


def _word(k: int, data: str = "data") -> Column:
    """The k-th 256-bit word of an event's data as decimal text."""
    return hex_text(F.substring(_digits(F.col(data)), 64 * k + 1, 64))


def _topic_address(k: int) -> Column:
    """The address in the low 20 bytes of a topic."""
    return F.concat(F.lit("0x"), F.right(_digits(F.get("topics", F.lit(k))), F.lit(40)))


def _whole_log(topics: int, words: int) -> Column:
    """Whether a log has its place, so many full topics and data words; unreadable digits make it false."""
    topic = lambda t: F.length(_digits(t)) == 64
    there = F.col("block_number").isNotNull() & F.col("log_index").isNotNull() & F.col("transaction_hash").isNotNull()
    full = (F.size("topics") >= topics) & F.forall(F.slice("topics", 1, topics), topic) & (F.length(_digits(F.col("data"))) >= 64 * words)
    return F.coalesce(there & full, F.lit(False))


def fills(logs: DataFrame) -> DataFrame:
    """Order-book fills from whole raw logs; :func:`undecodable` gives the others.

    Order hash, maker and taker come from the topics; asset ids, amounts and fee from the data words.
    Amounts are 256-bit on chain, so they stay text until a column is known to fit.
    """
    names = FILL.names
    return logs.where(_whole_log(4, 5)).select(
        "block_number", "transaction_hash", "log_index",
        F.lower(F.get("topics", F.lit(1))).alias(names[3]), _topic_address(2).alias(names[4]), _topic_address(3).alias(names[5]),
        *(_word(k).alias(names[6 + k]) for k in range(5)),
    )


def amm_trades(logs: DataFrame) -> DataFrame:
    """Buys and sells of market makers from whole raw logs; the first topic tells them apart, other events are not read.

    The outcome index stands in a topic; amount, fee and outcome tokens are data words and stay text.
    """
    event = F.lower(F.get("topics", F.lit(0)))
    rows = logs.where(event.isin(topic_of(BUY_EVENT), topic_of(SELL_EVENT)) & _whole_log(3, 3))
    return rows.select(
        "block_number", "transaction_hash", "log_index",
        F.lower("address").alias("fpmm_address"), _topic_address(1).alias("trader"), _word(0).alias("amount"), _word(1).alias("fee_amount"),
        hex_text(_digits(F.get("topics", F.lit(2)))).cast("bigint").alias("outcome_index"),
        _word(2).alias("outcome_tokens"), (event == topic_of(BUY_EVENT)).alias("is_buy"),
    )


def undecodable(logs: DataFrame, topics: int = 4, words: int = 5) -> DataFrame:
    """Logs that lack their place, a topic or a data word, or hold no hexadecimal digits: to be counted, never lost."""
    return logs.where(~_whole_log(topics, words))


def asset_hex(asset_id: str | None) -> str | None:
    """A 256-bit decimal id as 64 hex digits; null if it is no such number."""
    try:
        n = int(asset_id)
    except (TypeError, ValueError):
        return None
    return f"{n:064x}" if 0 <= n < 1 << 256 else None
