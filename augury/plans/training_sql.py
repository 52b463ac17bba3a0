"""SQL twins of the queries p1 to p5, for a second engine over the same tables."""

from __future__ import annotations


def _id(c: str) -> str:
    return f"nullif(lower(trim({c}, ' ' || chr(9))), '')"


def _ticker(c: str) -> str:
    return f"nullif(upper(trim({c}, ' ' || chr(9))), '')"


def _hash(c: str) -> str:
    return f"nullif(regexp_replace({_id(c)}, '^0x', ''), '')"


FILL = f"{_hash('transaction_hash')} || ':' || CAST(log_index AS VARCHAR)"


def _hot(name: str, key: str) -> str:
    return f"SELECT '{name}' AS src, k AS hot_key FROM (SELECT {key} AS k FROM {name}) WHERE k IS NOT NULL GROUP BY k HAVING count(*) >= 0.03 * (SELECT count(*) FROM {name})"


P1_FOUND = f"{_hot('k_trades', _ticker('ticker'))} UNION ALL {_hot('p_legacy', _id('fpmm_address'))}"

P1_TICKER_TOTALS = f"""
WITH t AS (SELECT {_ticker('ticker')} AS ticker, count(*) AS n_rows, CAST(sum("count") AS BIGINT) AS contracts FROM k_trades GROUP BY 1),
m AS (SELECT {_ticker('ticker')} AS ticker, max({_ticker('event_ticker')}) AS event_ticker FROM k_markets GROUP BY 1)
SELECT t.ticker, n_rows, contracts, event_ticker FROM t LEFT JOIN m USING (ticker) WHERE t.ticker IS NOT NULL"""

P1_ADDRESS_TOTALS = f"""
SELECT {_id('fpmm_address')} AS fpmm_address, count(*) AS n_rows, count(*) FILTER (is_buy) AS n_buys, CAST(sum(TRY_CAST(amount AS DECIMAL(38,0))) AS VARCHAR) AS amount
FROM p_legacy WHERE {_id('fpmm_address')} IS NOT NULL GROUP BY 1"""

P2_FOUND = f"""
WITH child AS (
  SELECT 'k_trades' AS src, {_ticker('ticker')} AS k, _fetched_at AS seen FROM k_trades
  UNION ALL SELECT 'p_legacy', {_id('fpmm_address')}, _fetched_at FROM p_legacy
  UNION ALL SELECT 'p_markets', {_id('market_maker_address')}, _fetched_at FROM p_markets),
parent AS (SELECT src, k, min(seen) AS born FROM (
  SELECT 'k_trades' AS src, {_ticker('ticker')} AS k, _fetched_at AS seen FROM k_markets
  UNION ALL SELECT 'p_legacy', {_id('market_maker_address')}, _fetched_at FROM p_markets
  UNION ALL SELECT 'p_markets', {_id('fpmm_address')}, _fetched_at FROM p_collateral) WHERE k IS NOT NULL GROUP BY 1, 2),
gone AS (SELECT CASE scope WHEN 'k_markets' THEN 'k_trades' WHEN 'p_markets' THEN 'p_legacy' WHEN 'p_collateral' THEN 'p_markets' END AS src,
  CASE scope WHEN 'k_markets' THEN {_ticker('ref_key')} ELSE {_id('ref_key')} END AS k, min(removed_at) AS gone FROM removals GROUP BY 1, 2),
kinds AS (SELECT c.src, strftime(c.seen, '%Y-%m') AS ref_month, c.k AS ref_key,
  CASE WHEN p.k IS NULL THEN 'missing' WHEN g.gone <= c.seen THEN 'deleted' WHEN p.born > c.seen THEN 'late' END AS kind
  FROM child c LEFT JOIN parent p ON c.src = p.src AND c.k = p.k LEFT JOIN gone g ON c.src = g.src AND c.k = g.k WHERE c.k IS NOT NULL)
SELECT DISTINCT src, ref_month, ref_key, kind FROM kinds WHERE kind IS NOT NULL"""

P2_REPORT = f"SELECT src, ref_month, kind, count(*) AS n_keys FROM ({P2_FOUND}) GROUP BY 1, 2, 3"

_DAILY = f"""
first_copy AS (SELECT {_ticker('ticker')} AS ticker, "count" AS c, created_time, _fetched_at FROM k_trades
  QUALIFY {_id('trade_id')} IS NULL OR row_number() OVER (PARTITION BY {_id('trade_id')} ORDER BY _fetched_at, "count", created_time, {_id('trade_id')}, {_ticker('ticker')}) = 1),
daily AS (SELECT ticker, CAST(created_time AS DATE) AS day, CAST(coalesce(sum(c), 0) AS BIGINT) AS total, count(*) AS n_trades FROM first_copy
  WHERE ticker IS NOT NULL AND created_time IS NOT NULL GROUP BY 1, 2),
span AS (SELECT ticker, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY 1),
dense AS (SELECT s.ticker, s.day, coalesce(d.total, 0) AS total, coalesce(d.n_trades, 0) AS n_trades FROM span s LEFT JOIN daily d ON s.ticker = d.ticker AND s.day = d.day),
rolled AS (SELECT ticker, day, n_trades,
  CAST(sum(total) OVER (PARTITION BY ticker ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS total_7,
  CAST(sum(total) OVER (PARTITION BY ticker ORDER BY day ROWS 29 PRECEDING) AS BIGINT) AS total_30 FROM dense)"""

P3_FOUND = f"WITH {_DAILY} SELECT ticker, strftime(day, '%Y-%m-%d') AS trade_day FROM rolled WHERE n_trades = 0 AND total_7 * 30 > total_30 * 7"

P3_ROLLING = f"""WITH {_DAILY} SELECT ticker, strftime(day, '%Y-%m-%d') AS trade_day, n_trades, total_7, total_30,
round(total_7 / 7.0, 6)::DOUBLE AS avg_7, round(total_30 / 30.0, 6)::DOUBLE AS avg_30 FROM rolled"""

P3_CORRECTED = f"""WITH {_DAILY}, late AS (SELECT DISTINCT ticker, CAST(CAST(created_time AS DATE) + CAST(i AS INTEGER) AS DATE) AS day FROM first_copy, range(30) r(i)
 WHERE _fetched_at >= TIMESTAMP '2024-01-01' AND ticker IS NOT NULL AND created_time IS NOT NULL)
SELECT ticker, strftime(day, '%Y-%m-%d') AS trade_day, n_trades, total_7, total_30, round(total_7 / 7.0, 6)::DOUBLE AS avg_7, round(total_30 / 30.0, 6)::DOUBLE AS avg_30 FROM rolled JOIN late USING (ticker, day)"""


def _note(table: str, field: str, note: str) -> str:
    """The power of the unit that comes first in the note (at one place the longest name), fee and taker clauses cut."""
    return f"""(SELECT arg_min(u.pow10, (instr(n.t, lower(u.unit_name)), -length(u.unit_name))) FROM unit_defs u,
 (SELECT regexp_replace(lower({note}), '(^|[/,;])\\s*(fee|taker)\\b[^/,;]*', '\\1', 'g') AS t) n
 WHERE u.tbl = '{table}' AND u.field_name = '{field}' AND u.source IS NULL AND regexp_matches(n.t, '(^|[^a-z0-9])' || lower(u.unit_name) || '($|[^a-z0-9])'))"""


_P4 = f"""notes_k AS (SELECT price_note AS note, {_note('k_trades', 'yes_price', 'price_note')} AS p FROM (SELECT DISTINCT price_note FROM k_trades WHERE price_note IS NOT NULL)),
notes_p AS (SELECT amount_note AS note, {_note('p_trades', 'maker_amount', 'amount_note')} AS p FROM (SELECT DISTINCT amount_note FROM p_trades WHERE amount_note IS NOT NULL)),
feeds AS (SELECT source, pow10 FROM unit_defs WHERE tbl = 'k_trades' AND source IS NOT NULL),
contracts AS (SELECT source, pow10 FROM unit_defs WHERE tbl = 'p_trades' AND source IS NOT NULL),
k AS (SELECT {_id('trade_id')} AS rec_key, yes_price AS v, coalesce(n.p, f.pow10, CASE
    WHEN abs(yes_price + no_price - 100) <= 1 THEN 2 WHEN abs(yes_price + no_price - 1000) <= 1 THEN 1
    WHEN abs(yes_price + no_price - 10000) <= 1 THEN 0 WHEN abs(yes_price + no_price - 1000000) <= 1 THEN -2 END) AS p
  FROM k_trades t LEFT JOIN notes_k n ON t.price_note = n.note LEFT JOIN feeds f ON t.feed = f.source WHERE yes_price IS NOT NULL),
p AS (SELECT {FILL} AS rec_key, maker_amount AS v, coalesce(n.p, c.pow10) AS p
  FROM p_trades t LEFT JOIN notes_p n ON t.amount_note = n.note LEFT JOIN contracts c ON t._contract = c.source WHERE maker_amount IS NOT NULL),
l0 AS (SELECT {FILL} AS rec_key, lower(trim(outcome_tokens)) AS s FROM p_legacy),
l1 AS (SELECT rec_key, s, regexp_extract(s, '(thousand shares|18 decimals|6 decimals|shares|tokens|token|milli|micro|gwei|ktok|mtok|wei|sh)', 1) AS u FROM l0
  WHERE NOT regexp_matches(s, '^0x') AND NOT regexp_matches(s, '^[0-9.]+e[+-]?[0-9]+$')),
l2 AS (SELECT rec_key, u, regexp_replace(CASE WHEN u = '' THEN s ELSE replace(s, u, '') END, '[ ,:()\\[\\]]', '', 'g') AS n FROM l1),
l AS (SELECT rec_key, n, CASE WHEN u = '' THEN 18 ELSE (SELECT max(pow10) FROM unit_defs d WHERE d.tbl = 'p_legacy' AND d.unit_name = u) END AS p FROM l2
  WHERE regexp_matches(n, '^[0-9]+([.][0-9]+)?$') AND (u <> '' OR n LIKE '%.%'))"""

P4_FOUND = f"""WITH {_P4}
SELECT DISTINCT 'k_trades' AS src, rec_key, CAST(CASE WHEN p >= 0 THEN CAST(v AS HUGEINT) * CAST(power(10, p) AS HUGEINT) ELSE CAST(v AS HUGEINT) // CAST(power(10, -p) AS HUGEINT) END AS VARCHAR) AS val FROM k WHERE p <> 2
UNION ALL SELECT DISTINCT 'p_trades', rec_key, CAST(CASE WHEN p >= 0 THEN CAST(v AS HUGEINT) * CAST(power(10, p) AS HUGEINT) ELSE CAST(v AS HUGEINT) // CAST(power(10, -p) AS HUGEINT) END AS VARCHAR) FROM p WHERE p <> 0
UNION ALL SELECT DISTINCT 'p_legacy', rec_key, ltrim(split_part(n, '.', 1) || rpad(split_part(n, '.', 2), CAST(p AS INTEGER), '0'), '0') FROM l WHERE p <> 0"""

P4_UNITS = f"""WITH {_P4},
kn AS (SELECT 'k_trades' AS src, v IS NOT NULL AS ok, p FROM k UNION ALL SELECT 'k_trades', false, NULL FROM k_trades WHERE yes_price IS NULL),
pn AS (SELECT 'p_trades' AS src, true AS ok, p FROM p UNION ALL SELECT 'p_trades', false, NULL FROM p_trades WHERE maker_amount IS NULL),
ln AS (SELECT 'p_legacy' AS src, false AS ok, CASE WHEN regexp_matches(s, '^0x[0-9a-f]+$') OR regexp_matches(s, '^[0-9.]+e[+-]?[0-9]+$') OR regexp_matches(s, '^[0-9]+([, ]+[0-9]+)*$') THEN 0 ELSE (SELECT max(l.p) FROM l WHERE l.rec_key = l0.rec_key) END AS p FROM l0)
SELECT src, CAST(p AS INTEGER) AS power, ok AND p IS NULL AS uncertain, count(*) AS n_rows FROM (SELECT * FROM kn UNION ALL SELECT * FROM pn UNION ALL SELECT * FROM ln) GROUP BY 1, 2, 3"""


def _copies(name: str, key: str) -> str:
    return f"SELECT '{name}' AS src, k AS msg_key, count(*) AS n_copies FROM (SELECT {key} AS k FROM {name}) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1"


P5_FOUND = f"{_copies('k_trades', _id('trade_id'))} UNION ALL {_copies('p_trades', FILL)}"

P5_TRADES = f"""
SELECT {_id('trade_id')} AS msg_key, {_ticker('ticker')} AS ticker, "count", yes_price, no_price, created_time, _fetched_at FROM k_trades
QUALIFY {_id('trade_id')} IS NULL OR row_number() OVER (PARTITION BY {_id('trade_id')} ORDER BY _fetched_at NULLS LAST, "count" NULLS LAST, created_time NULLS LAST, feed NULLS LAST, no_price NULLS LAST, price_note NULLS LAST, taker_side NULLS LAST, k_trades.ticker NULLS LAST, trade_id NULLS LAST, yes_price NULLS LAST) = 1"""

P5_FILLS = f"""
SELECT {FILL} AS msg_key, block_number, {_hash('order_hash')} AS order_hash, maker_amount, taker_amount, fee, _fetched_at FROM p_trades
QUALIFY {FILL} IS NULL OR row_number() OVER (PARTITION BY {FILL} ORDER BY _fetched_at NULLS LAST, _contract NULLS LAST, amount_note NULLS LAST, block_number NULLS LAST, fee NULLS LAST, log_index NULLS LAST, maker NULLS LAST, maker_amount NULLS LAST, maker_asset_id NULLS LAST, p_trades.order_hash NULLS LAST, taker NULLS LAST, taker_amount NULLS LAST, taker_asset_id NULLS LAST, transaction_hash NULLS LAST) = 1"""

P5_ADMITTED = f"""
WITH r AS (SELECT {_id('trade_id')} AS msg_key, trade_id, "count", _fetched_at, coalesce(_fetched_at >= TIMESTAMP '2024-01-01', false) AS late FROM k_trades)
SELECT msg_key, "count", _fetched_at FROM r WHERE late AND (msg_key IS NULL OR msg_key NOT IN (SELECT msg_key FROM r WHERE NOT late AND msg_key IS NOT NULL))
QUALIFY msg_key IS NULL OR row_number() OVER (PARTITION BY msg_key ORDER BY _fetched_at NULLS LAST, "count" NULLS LAST, trade_id NULLS LAST) = 1"""

SQL = {k.lower(): v for k, v in list(globals().items()) if k[0] == "P" and k[1].isdigit()}
