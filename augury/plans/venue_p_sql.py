"""SQL twins of the analyses of the on-chain venue and across venues."""

from __future__ import annotations

from augury.plans.training_sql import FILL, _id, _note
from augury.plans.venue_k_sql import POSITIONS, _b, _r, first_rows

_LIST = """'^\\s*\\[\\s*("[^"]*"|[0-9.]+)\\s*(,\\s*("[^"]*"|[0-9.]+)\\s*)*\\]\\s*$'"""


def _items(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {_LIST}) THEN string_split(regexp_replace({c}, '[\\[\\]\" ]', '', 'g'), ',') END"


MARKETS = f"""pm AS (SELECT id, {_items('outcome_prices')} AS prices, {_items('clob_token_ids')} AS tokens, {_id('market_maker_address')} AS address, closed FROM p_markets
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY _fetched_at DESC NULLS LAST, outcome_prices NULLS LAST, clob_token_ids NULLS LAST, {_id('market_maker_address')} NULLS LAST) = 1),
res AS (SELECT id, tokens, address, CASE WHEN TRY_CAST(prices[1] AS DOUBLE) > 0.99 AND TRY_CAST(prices[2] AS DOUBLE) < 0.01 THEN 0 WHEN TRY_CAST(prices[2] AS DOUBLE) > 0.99 AND TRY_CAST(prices[1] AS DOUBLE) < 0.01 THEN 1 END AS winner FROM pm WHERE closed AND len(prices) = 2),
tok AS (SELECT token_id, won FROM (SELECT id, tokens[p] AS token_id, p - 1 = winner AS won, p FROM res, (VALUES (1), (2)) v(p) WHERE winner IS NOT NULL AND len(tokens) = 2) QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY id DESC, p DESC) = 1),
usdc AS (SELECT DISTINCT {_id('fpmm_address')} AS address FROM p_collateral WHERE collateral_symbol = 'USDC'),
amm AS (SELECT address, arg_max(winner, id) AS winner FROM res WHERE winner IS NOT NULL AND address IN (SELECT address FROM usdc) GROUP BY 1)"""
P_COLUMNS = ("_contract", "amount_note", "block_number", "fee", "log_index", "maker", "maker_amount", "maker_asset_id", "order_hash", "taker", "taker_amount", "taker_asset_id", "transaction_hash")
FILLS = f"""notes_p AS (SELECT amount_note AS note, {_note('p_trades', 'maker_amount', 'amount_note')} AS named FROM (SELECT DISTINCT amount_note FROM p_trades WHERE amount_note IS NOT NULL)),
contracts AS (SELECT source, pow10 FROM unit_defs WHERE tbl = 'p_trades' AND source IS NOT NULL), fill_rows AS ({first_rows('p_trades', FILL, P_COLUMNS)}),
fill_units AS (SELECT r.*, coalesce(named, pow10) AS p FROM fill_rows r LEFT JOIN notes_p ON amount_note = note LEFT JOIN contracts ON _contract = source),
fills AS (SELECT block_number, maker_asset_id, taker_asset_id, taker_amount, CASE WHEN p < 0 THEN maker_amount::DOUBLE / power(10.0::DOUBLE, -p) ELSE maker_amount::DOUBLE * power(10.0::DOUBLE, p) END AS maker_amount FROM fill_units)"""
# Amounts of outcome tokens as whole numbers of 1e-18 tokens, from any way of writing them.
AMM = f"""amm_texts AS (SELECT block_number, {_id('fpmm_address')} AS fpmm_address, TRY_CAST(amount AS DOUBLE) AS amount, outcome_index, lower(trim(outcome_tokens, ' ' || chr(9))) AS s FROM p_legacy),
amm_words AS (SELECT *, (SELECT arg_max((unit_name, pow10), length(unit_name)) FROM unit_defs WHERE tbl = 'p_legacy' AND source IS NULL AND regexp_matches(s, '(^|[^a-z0-9])' || unit_name || '($|[^a-z0-9])')) AS u FROM amm_texts),
amm_numbers AS (SELECT *, regexp_replace(CASE WHEN u IS NULL THEN s ELSE replace(s, u[1], '') END, '[, ()\\[\\]:=\\t]', '', 'g') AS n FROM amm_words),
amm_trades AS (SELECT block_number, fpmm_address, amount, outcome_index, CASE
 WHEN regexp_full_match(s, '0x[0-9a-f]+') THEN list_reduce(list_prepend(0.0::DOUBLE, list_transform(string_split(substr(s, 3), ''), lambda h: instr('123456789abcdef', h)::DOUBLE)), lambda a, h: a * 16 + h)
 WHEN regexp_full_match(s, '[+-]?[0-9]+([.][0-9]+)?e[+-]?[0-9]+') THEN s::DOUBLE
 WHEN u IS NULL AND regexp_full_match(n, '[+-]?[0-9]+') THEN n::DOUBLE
 WHEN regexp_full_match(n, '[+-]?[0-9]+([.][0-9]+)?') THEN (split_part(n, '.', 1) || rpad(split_part(n, '.', 2), coalesce(u[2], 18), '0'))::HUGEINT::DOUBLE END / 1e12 AS tokens FROM amm_numbers)"""
POS = f"""{FILLS}, {AMM}, f AS (SELECT block_number, won, CASE WHEN maker_asset_id = '0' THEN 100.0::DOUBLE * maker_amount::DOUBLE / taker_amount::DOUBLE ELSE 100.0::DOUBLE * taker_amount::DOUBLE / maker_amount::DOUBLE END AS c
 FROM fills JOIN tok ON CASE WHEN maker_asset_id = '0' THEN taker_asset_id ELSE maker_asset_id END = token_id WHERE taker_amount > 0 AND maker_amount > 0),
l AS (SELECT block_number, outcome_index = winner AS won, 100.0::DOUBLE * amount / tokens AS c FROM amm_trades JOIN amm ON fpmm_address = amm.address WHERE tokens > 0),
u AS (SELECT * FROM f UNION ALL SELECT * FROM l),
ppos AS (SELECT * FROM (SELECT block_number, round(c) AS price, won FROM u UNION ALL SELECT block_number, round(100.0::DOUBLE - c), NOT won FROM u) WHERE price BETWEEN 1 AND 99)"""
TIMES = "bt AS (SELECT block_number // 10800 AS bucket, arg_min(CAST(replace(replace(timestamp, 'Z', ''), '+00:00', '') AS TIMESTAMP), block_number) AS seen FROM p_blocks GROUP BY 1)"
BY_PRICE = f"WITH {MARKETS}, {POS}, g AS (SELECT price, count(*) AS n, count(*) FILTER (won) AS w FROM ppos GROUP BY 1)"

POLYMARKET_WIN_RATE_BY_PRICE = f"{BY_PRICE} SELECT price, n AS total_trades, w AS wins, {_r('100.0 * w / n', 'win_rate')} FROM g"
CALIBRATION_METRICS = f"""{BY_PRICE}, h AS (SELECT *, price / 100.0 AS p FROM g)
SELECT round(sum(w * (p - 1) * (p - 1) + (n - w) * p * p) / sum(n), 4) AS brier_score, round(-sum(w * ln(p) + (n - w) * ln(1 - p)) / sum(n), 4) AS log_loss, round(sum(abs(w / n - p) * n) / sum(n), 4) AS ece, {_b('sum(n)', 'total_trades')} FROM h"""
_BUCKETS = f"WITH {MARKETS}, {POS}, b AS (SELECT floor(price / 10) * 10 AS bucket_low, count(*) AS n, count(*) FILTER (won) AS w, avg(price) AS m FROM ppos GROUP BY 1)"
POLYMARKET_CALIBRATION_BY_BUCKET = f"{_BUCKETS} SELECT bucket_low, n AS total_trades, w AS wins, {_r('m', 'mean_predicted')}, {_r('100.0 * w / n', 'actual_rate')} FROM b"
BUCKET_METRICS = f"""{_BUCKETS} SELECT round(sum(abs(100.0 * w / n - m) * n) / sum(n), 2) AS ece, round(max(abs(100.0 * w / n - m)), 2) AS mce, round(sum(w * (m / 100 - 1) ** 2 + (n - w) * (m / 100) ** 2) / sum(n), 4) AS brier_score, {_b('sum(n)', 'total_trades')}, count(*) AS num_buckets FROM b"""
POLYMARKET_TRADES_OVER_TIME = f"""WITH {FILLS}, c AS (SELECT block_number, count(*) AS n FROM (SELECT block_number FROM fills UNION ALL SELECT block_number FROM p_legacy) GROUP BY 1), b AS (SELECT block_number, min(timestamp) AS t FROM p_blocks GROUP BY 1)
SELECT block_number, t AS timestamp, n AS trade_count, CAST(replace(replace(t, 'Z', ''), '+00:00', '') AS TIMESTAMP) AS datetime FROM c JOIN b USING (block_number)"""
POLYMARKET_VOLUME_OVER_TIME = f"""WITH {MARKETS}, {FILLS}, {TIMES}, v AS (
 SELECT block_number // 10800 AS bucket, CASE WHEN maker_asset_id = '0' THEN CAST(taker_amount AS HUGEINT) ELSE CAST(round(maker_amount) AS HUGEINT) END AS v FROM fills WHERE maker_asset_id = '0' OR taker_asset_id = '0'
 UNION ALL SELECT block_number // 10800, TRY_CAST(amount AS HUGEINT) FROM p_legacy WHERE {_id('fpmm_address')} IN (SELECT address FROM usdc))
SELECT CAST(date_trunc('quarter', seen) AS TIMESTAMP) AS quarter, round(CAST(sum(v) AS DOUBLE) / 1e6, 6) AS volume_usd FROM v JOIN bt USING (bucket) GROUP BY 1"""
_SNAPSHOTS = f"""{POSITIONS}, {MARKETS}, {POS}, {TIMES},
d AS (SELECT 'kalshi' AS platform, CAST(created_time AS DATE) AS day, price, won = 1 AS won FROM pos WHERE price BETWEEN 1 AND 99 AND created_time IS NOT NULL
 UNION ALL SELECT 'polymarket', CAST(seen AS DATE), CAST(price AS INTEGER), won FROM ppos JOIN bt ON block_number // 10800 = bucket),
days AS (SELECT DISTINCT platform, day FROM d), n AS (SELECT platform, day, price, count(*) AS n, count(*) FILTER (won) AS w FROM d GROUP BY 1, 2, 3),
s AS (SELECT days.platform, days.day, n.price, sum(n.n) AS total, sum(n.w) AS wins FROM days JOIN n ON n.platform = days.platform AND n.day <= days.day GROUP BY 1, 2, 3),
ok AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT day FROM (SELECT platform, day, sum(total) AS t FROM s GROUP BY 1, 2) GROUP BY day HAVING max(t) >= 1000))"""
DAILY_CUMULATIVE_SNAPSHOT = f"{_SNAPSHOTS} SELECT platform, strftime(day, '%Y-%m-%d') AS day, price, {_b('total', 'total')}, {_b('wins', 'wins')} FROM s"
EVERY_OTHER_DAY = f"{_SNAPSHOTS} SELECT strftime(day, '%Y-%m-%d') AS day, (k + 1) // 2 AS frame FROM ok WHERE k % 2 = 1"
WIN_RATE_BY_PRICE_ANIMATED = f"{_SNAPSHOTS} SELECT platform, price, {_b('total', 'total')}, {_b('wins', 'wins')}, {_r('100.0 * wins / total', 'win_rate')} FROM s WHERE day = (SELECT max(day) FROM ok WHERE k % 2 = 1)"
ANIMATION_FRAMES = f"""{_SNAPSHOTS}, fr AS (SELECT day, (k + 1) // 2 AS frame FROM ok WHERE k % 2 = 1), top AS (SELECT max(frame) AS m FROM fr),
fx AS (SELECT day, frame FROM fr UNION ALL SELECT day, frame + i FROM fr, top, range(1, 11) r(i) WHERE frame = m),
a AS (SELECT frame, platform, max(s.day) AS day FROM fx JOIN days s ON s.day <= fx.day GROUP BY 1, 2)
SELECT frame, platform, price, {_b('total', 'total')}, {_b('wins', 'wins')}, {_r('100.0 * wins / total', 'win_rate')} FROM a JOIN s USING (platform, day)"""

SQL = {k.lower(): v for k, v in list(globals().items()) if k.isupper() and isinstance(v, str) and k not in {"MARKETS", "POS", "TIMES", "FILL", "FILLS", "AMM", "BY_PRICE", "POSITIONS"} and not k.startswith("_")}
