"""Explicit schemas of the stored relations; optional columns may be absent when read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {
        "string": T.StringType(),
        "bigint": T.LongType(),
        "int": T.IntegerType(),
        "double": T.DoubleType(),
        "boolean": T.BooleanType(),
        "timestamp_ntz": T.TimestampNTZType()
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split() for c in text.split(","))])


K_TRADES = _schema(
    "trade_id string,ticker string,count bigint,yes_price int,no_price int,taker_side string,created_time timestamp_ntz,_fetched_at timestamp_ntz"
)
K_MARKETS = _schema(
    "ticker string,event_ticker string,market_type string,title string,yes_sub_title string,no_sub_title string,status string,yes_bid int,yes_ask int,no_bid int,no_ask int,last_price int,"
    "volume bigint,volume_24h bigint,open_interest bigint,result string,created_time timestamp_ntz,open_time timestamp_ntz,close_time timestamp_ntz,_fetched_at timestamp_ntz"
)
P_TRADES = _schema(
    "block_number bigint,transaction_hash string,log_index bigint,order_hash string,maker string,taker string,maker_asset_id string,taker_asset_id string,maker_amount bigint,taker_amount bigint,fee bigint,_fetched_at timestamp_ntz,_contract string"
)
P_LEGACY = _schema(
    "block_number bigint,transaction_hash string,log_index bigint,fpmm_address string,trader string,amount string,fee_amount string,outcome_index bigint,outcome_tokens string,is_buy boolean,timestamp bigint,_fetched_at timestamp_ntz"
)
P_MARKETS = _schema(
    "id string,condition_id string,question string,slug string,outcomes string,outcome_prices string,clob_token_ids string,volume double,liquidity double,active boolean,closed boolean,"
    "end_date timestamp_ntz,created_at timestamp_ntz,market_maker_address string,_fetched_at timestamp_ntz"
)
P_COLLATERAL = _schema("fpmm_address string,collateral_symbol string,collateral_decimals int,_fetched_at timestamp_ntz")
P_BLOCKS = _schema("block_number bigint,timestamp string")


def conform(df: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema`` in order; absent optional ones are null, absent required ones raise."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are absent: {', '.join(missing)}")
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
