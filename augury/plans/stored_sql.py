"""SQL twins of the queries over decoders and stores."""

from __future__ import annotations

from augury.plans.stored import CHUNK
from augury.plans.training_sql import FILL, _id, _ticker
from augury.plans.venue_k_sql import MARKETS, TRADES
from augury.plans.venue_p_sql import _LIST

_WHOLE = "order_hash IS NOT NULL AND maker IS NOT NULL AND taker IS NOT NULL AND block_number IS NOT NULL AND log_index IS NOT NULL AND transaction_hash IS NOT NULL AND maker_amount IS NOT NULL AND taker_amount IS NOT NULL AND fee IS NOT NULL"
FILL_LOG_ROUND_TRIP = f"SELECT {FILL} AS msg_key, {_id('order_hash')} AS order_hash, {_id('maker')} AS maker, {_id('taker')} AS taker, CAST(maker_amount AS VARCHAR) AS maker_amount, CAST(taker_amount AS VARCHAR) AS taker_amount, CAST(fee AS VARCHAR) AS fee FROM p_trades WHERE {_WHOLE}"
UNDECODABLE_LOGS = f"SELECT count(*) FILTER (NOT ({_WHOLE})) AS n_undecodable, count(*) AS n_logs FROM p_trades"
AMM_LOG_ROUND_TRIP = f"""SELECT {FILL} AS msg_key, {_id('fpmm_address')} AS fpmm_address, {_id('trader')} AS trader, CAST(CAST(amount AS BIGINT) AS VARCHAR) AS amount, CAST(CAST(fee_amount AS BIGINT) AS VARCHAR) AS fee_amount,
 outcome_index, CAST(log_index AS VARCHAR) AS outcome_tokens, is_buy FROM p_legacy WHERE is_buy IS NOT NULL AND trader IS NOT NULL AND outcome_index IS NOT NULL AND amount IS NOT NULL AND fee_amount IS NOT NULL AND log_index IS NOT NULL AND block_number IS NOT NULL AND transaction_hash IS NOT NULL"""
CHUNKED_STORE = f"WITH n AS (SELECT count(DISTINCT id) AS n FROM p_markets) SELECT i * {CHUNK} AS chunk, least({CHUNK}, n - i * {CHUNK}) AS n_rows, least({CHUNK}, n - i * {CHUNK}) AS n_ids FROM n, range(0, 1000000) r(i) WHERE i * {CHUNK} < n"
BLOCK_STORE = """SELECT block_number // 1000000 AS part, count(DISTINCT block_number) AS n_blocks, min(block_number) AS first, max(block_number) AS last, (SELECT max(block_number) + 1 FROM p_blocks) AS next_block FROM p_blocks GROUP BY 1"""
WANTED_TICKERS = f"WITH {MARKETS} SELECT DISTINCT ticker FROM markets WHERE volume >= 100 AND ticker NOT IN (SELECT {_ticker('ticker')} FROM k_trades WHERE {_ticker('ticker')} IS NOT NULL AND _fetched_at < TIMESTAMP '2023-04-01')"
LAST_ROW_FLAG = f"WITH {TRADES}, q AS (SELECT CAST(date_trunc('quarter', created_time) AS TIMESTAMP) AS quarter, CAST(sum(c) AS BIGINT) AS volume_usd FROM trades WHERE created_time IS NOT NULL GROUP BY 1) SELECT quarter, volume_usd, quarter = (SELECT max(quarter) FROM q) AS is_last FROM q"
_HUMAN = lambda x: f"CASE WHEN {x} >= 1000000 THEN printf('%.1fM', {x} / 1000000.0::DOUBLE) WHEN {x} >= 1000 THEN printf('%.0fK', {x} / 1000.0::DOUBLE) ELSE CAST({x} AS VARCHAR) END"
TRADE_COUNT_LABELS = f"""WITH g AS (SELECT {_ticker('ticker')} AS ticker, count(*) AS n, CAST(sum("count") AS BIGINT) AS c FROM k_trades GROUP BY 1) SELECT ticker, {_HUMAN('n')} AS trades, {_HUMAN('(c * 1000)')} AS thousandths FROM g WHERE ticker IS NOT NULL"""
PRICE_GAPS = f"""WITH {TRADES}, s AS (SELECT 'yes' AS side, yes_price IS NOT NULL AS recorded, p IS NOT NULL AS has_unit FROM trades_units UNION ALL SELECT 'no', no_price IS NOT NULL, p IS NOT NULL FROM trades_units)
SELECT side, recorded, has_unit, count(*) AS n FROM s GROUP BY 1, 2, 3"""
_KIND = lambda c: f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 'none' WHEN regexp_matches({c}, {_LIST}) OR trim({c}) = '[]' THEN 'list' ELSE 'skipped' END"
JSON_SKIPPED = f"""WITH pm AS (SELECT * FROM p_markets QUALIFY row_number() OVER (PARTITION BY id ORDER BY _fetched_at DESC NULLS LAST, outcome_prices NULLS LAST, clob_token_ids NULLS LAST, {_id('market_maker_address')} NULLS LAST) = 1)
SELECT {_KIND('outcome_prices')} AS prices, {_KIND('clob_token_ids')} AS tokens, count(*) AS n FROM pm WHERE closed GROUP BY 1, 2"""

SQL = {k.lower(): v for k, v in list(globals().items()) if k.isupper() and isinstance(v, str) and k not in {"FILL", "MARKETS", "TRADES"} and not k.startswith("_")}
