"""SQL twins of the analyses of the order-book venue, written from their definitions."""

from __future__ import annotations

from augury.functions.classify import DEFAULT_RULES
from augury.plans.training_sql import _id, _note, _ticker

K_COLUMNS = ("count", "created_time", "feed", "no_price", "price_note", "taker_side", "ticker", "trade_id", "yes_price")


def first_rows(table: str, key: str, columns: tuple[str, ...]) -> str:
    """All rows of a stored table but later copies of a key; ties go by all columns in name order."""
    order = ", ".join(f'{table}."{c}" NULLS LAST' for c in columns)
    return f"""SELECT * FROM {table} QUALIFY {key} IS NULL OR row_number() OVER (PARTITION BY {key} ORDER BY {table}._fetched_at NULLS LAST, {order}) = 1"""


def _cents(price: str) -> str:
    step = "CAST(power(10, 2 - p) AS BIGINT)"
    return f"CAST(({price} + {step} // 2) // {step} AS INTEGER) AS {price}"


def priced_trades(name: str, rows: str) -> str:
    """Stored trades with both prices in whole cents: unit by note, else by feed, else by the dollar both prices make."""
    dollar = " ".join(f"WHEN abs(yes_price + no_price - {10 ** (4 - p)}) <= 1 THEN {p}" for p in (2, 1, 0, -2))
    return f"""notes_k AS (SELECT price_note AS note, {_note('k_trades', 'yes_price', 'price_note')} AS named FROM (SELECT DISTINCT price_note FROM k_trades WHERE price_note IS NOT NULL)),
feeds AS (SELECT source, pow10 FROM unit_defs WHERE tbl = 'k_trades' AND source IS NOT NULL), {name}_rows AS ({rows}),
{name}_units AS (SELECT r.*, coalesce(named, pow10, CASE {dollar} END) AS p FROM {name}_rows r LEFT JOIN notes_k ON price_note = note LEFT JOIN feeds ON feed = source),
{name} AS (SELECT {_ticker('ticker')} AS ticker, "count" AS c, {_cents('yes_price')}, {_cents('no_price')}, taker_side, created_time FROM {name}_units)"""


TRADES = priced_trades("trades", first_rows("k_trades", _id("trade_id"), K_COLUMNS))
MARKETS = f"""markets AS (SELECT {_ticker('ticker')} AS ticker, status, result, event_ticker, volume FROM k_markets WHERE {_ticker('ticker')} IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY {_ticker('ticker')} ORDER BY _fetched_at DESC NULLS LAST, status NULLS LAST, result NULLS LAST, event_ticker NULLS LAST, volume NULLS LAST) = 1)"""
RESOLVED = "resolved AS (SELECT ticker, event_ticker, result FROM markets WHERE status = 'finalized' AND result IN ('yes', 'no'))"
TAKER_PRICE = "CASE WHEN taker_side = 'yes' THEN yes_price ELSE no_price END"
MAKER_PRICE = "CASE WHEN taker_side = 'yes' THEN no_price ELSE yes_price END"
TAKER_WON = "CASE WHEN taker_side = result THEN 1.0 ELSE 0.0 END"
MAKER_WON = "CASE WHEN taker_side <> result THEN 1.0 ELSE 0.0 END"
CAT = "CASE WHEN event_ticker IS NULL OR event_ticker = '' OR regexp_extract(event_ticker, '^([A-Z0-9]+)', 1) = '' THEN 'independent' ELSE regexp_extract(event_ticker, '^([A-Z0-9]+)', 1) END"
WHICH = lambda field: "CASE " + " ".join(f"WHEN contains(upper(cat), '{r.pattern}') THEN '{getattr(r, field)}'" for r in DEFAULT_RULES) + f" ELSE {'cat' if field == 'subcategory' else repr('Other')} END"
BASE = f"WITH {TRADES}, {MARKETS}, {RESOLVED}"
TAKER = f"taker AS (SELECT 'taker' AS role, t.*, event_ticker, result, {TAKER_PRICE} AS price, {TAKER_WON} AS won FROM trades t JOIN resolved USING (ticker))"
MAKER = f"maker AS (SELECT 'maker' AS role, t.*, event_ticker, result, {MAKER_PRICE} AS price, {MAKER_WON} AS won FROM trades t JOIN resolved USING (ticker))"
POSITIONS = f"{BASE}, {TAKER}, {MAKER}, pos AS (SELECT * FROM taker UNION ALL SELECT * FROM maker)"
BETS = f"""{BASE}, bets AS (
 SELECT 'yes' AS side, yes_price AS price, CASE WHEN result = 'yes' THEN 1.0 ELSE 0.0 END AS won, c FROM trades JOIN resolved USING (ticker) WHERE taker_side = 'no'
 UNION ALL SELECT 'no', no_price, CASE WHEN result = 'no' THEN 1.0 ELSE 0.0 END, c FROM trades JOIN resolved USING (ticker) WHERE taker_side = 'yes')"""


def _r(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) AS {name}"


def _b(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


WIN_RATE_BY_PRICE = f"{POSITIONS} SELECT price, count(*) AS total_trades, {_b('sum(won)', 'wins')}, {_r('100.0 * sum(won) / count(*)', 'win_rate')} FROM pos GROUP BY price"

_STATS = lambda n, src: f"{n} AS (SELECT price, count(*) AS n, sum(won) AS w, 100.0 * sum(won) / count(*) AS r FROM {src} WHERE price BETWEEN 1 AND 99 GROUP BY price)"
MISPRICING_BY_PRICE = f"""{POSITIONS}, {_STATS('a', 'taker')}, {_STATS('b', 'maker')}, {_STATS('c', 'pos')}
SELECT price, a.n AS taker_trades, {_b('a.w', 'taker_wins')}, {_r('a.r', 'taker_win_rate')}, b.n AS maker_trades, {_b('b.w', 'maker_wins')}, {_r('b.r', 'maker_win_rate')},
c.n AS combined_trades, {_b('c.w', 'combined_wins')}, {_r('c.r', 'combined_win_rate')}, CAST(price AS DOUBLE) AS implied_probability,
{', '.join(_r(f'({x}.r - price) / price * 100', f'{y}_mispricing_pct') + ', ' + _r(f'{x}.r - price', f'{y}_mispricing_pp') for x, y in (('a', 'taker'), ('b', 'maker'), ('c', 'combined')))}
FROM a JOIN b USING (price) JOIN c USING (price)"""

_RET = lambda n: f"{n}s AS (SELECT price, avg(won) AS wr, price / 100.0 AS e, avg(won) - price / 100.0 AS x, var_pop(won - price / 100.0) AS v, count(*) AS n, sum(c * price / 100.0) AS vol, sum(c * (won - price / 100.0)) AS pnl FROM {n} WHERE price BETWEEN 1 AND 99 GROUP BY price)"
MAKER_VS_TAKER_RETURNS = f"""{POSITIONS}, {_RET('taker')}, {_RET('maker')} SELECT price, {', '.join(f"{_r(f'{n}s.wr', f'{n}_win_rate')}, {_r(f'{n}s.e', f'{n}_expected')}, {_r(f'{n}s.x', f'{n}_excess')}, {_r(f'{n}s.v', f'{n}_var')}, {n}s.n AS {n}_n, {_r(f'{n}s.vol', f'{n}_volume')}, {_r(f'{n}s.pnl', f'{n}_pnl')}, {_r(f'sqrt({n}s.v / {n}s.n)', f'{n}_se')}, {_r(f'{n}s.x / nullif(sqrt({n}s.v / {n}s.n), 0)', f'{n}_z')}" for n in ('taker', 'maker'))} FROM takers JOIN makers USING (price)"""

_DIR = lambda s: f"{s}s AS (SELECT price, avg(won) AS wr, avg(won) - price / 100.0 AS x, count(*) AS n, sum(c) AS c, sum(c * price / 100.0) AS vol, sum(won * c) / nullif(sum(c), 0) AS wwr FROM bets WHERE side = '{s}' AND price BETWEEN 1 AND 99 GROUP BY price)"
MAKER_RETURNS_BY_DIRECTION = f"""{BETS}, {_DIR('yes')}, {_DIR('no')} SELECT price, {', '.join(f"{_r(f'{s}s.wr', f'{s}_win_rate')}, {_r(f'{s}s.x', f'{s}_excess')}, {s}s.n AS {s}_n, {_b(f'{s}s.c', f'{s}_contracts')}, {_r(f'{s}s.vol', f'{s}_volume')}" for s in ('yes', 'no'))}, {_r('nos.x - yess.x', 'diff')} FROM yess FULL JOIN nos USING (price)"""
MAKER_WIN_RATE_BY_DIRECTION = f"""{BETS}, {_DIR('yes')}, {_DIR('no')} SELECT price, {', '.join(f"{_r(f'{s}s.wwr', f'{s}_win_rate')}, {_r(f'{s}s.wwr - price / 100.0', f'{s}_mispricing')}, {s}s.n AS {s}_n, {_b(f'{s}s.c', f'{s}_contracts')}" for s in ('yes', 'no'))}, {_r('price / 100.0', 'implied_prob')} FROM yess FULL JOIN nos USING (price)"""

_GAP = lambda n: f"{n}q AS (SELECT date_trunc('quarter', created_time) AS quarter, avg(won - price / 100.0) * 100 AS x, count(*) AS n, sum(c * price / 100.0) AS vol FROM {n} WHERE created_time IS NOT NULL GROUP BY 1 HAVING count(*) >= 1000)"
MAKER_TAKER_GAP_QUARTERLY = f"{POSITIONS}, {_GAP('taker')}, {_GAP('maker')} SELECT CAST(quarter AS TIMESTAMP) AS quarter, {_r('takerq.x', 'taker_return')}, {_r('makerq.x', 'maker_return')}, {_r('makerq.x - takerq.x', 'gap_pp')}, takerq.n AS n_trades, {_r('takerq.vol', 'volume_usd')} FROM takerq JOIN makerq USING (quarter)"

_CATS = lambda n: f"{n}c AS (SELECT {CAT} AS cat, avg(won - price / 100.0) AS x, count(*) AS n, sum(c) AS c, sum(c * price / 100.0) AS vol, sum(c * (won - price / 100.0)) AS pnl FROM {n} GROUP BY 1)"
RETURNS_BY_CATEGORY = f"""{POSITIONS}, {_CATS('taker')}, {_CATS('maker')}, g AS (SELECT {WHICH('group')} AS "group", sum(t.x * t.c) / sum(t.c) * 100 AS tx, sum(m.x * m.c) / sum(m.c) * 100 AS mx, sum(t.n) AS tn, sum(m.n) AS mn, sum(t.vol) AS tv, sum(m.vol) AS mv, sum(t.pnl) AS tp, sum(m.pnl) AS mp FROM takerc t JOIN makerc m USING (cat) GROUP BY 1)
SELECT "group", {_r('tx', 'taker_excess')}, {_r('mx', 'maker_excess')}, {_r('mx - tx', 'gap')}, {_b('tn', 'taker_n')}, {_b('mn', 'maker_n')}, {_r('tv', 'taker_volume')}, {_r('mv', 'maker_volume')}, {_r('tp', 'taker_pnl')}, {_r('mp', 'maker_pnl')} FROM g"""

TRADE_SIZE_BY_ROLE = f"""{POSITIONS}, s AS (SELECT role, c, c * price / 100.0 AS u FROM pos) SELECT role, {_r('avg(u)', 'mean_trade_size')}, {_r('median(u)', 'median_trade_size')}, {_r('stddev_pop(u)', 'std_trade_size')},
{', '.join(_r(f'quantile_cont(u, {q})', f'p{p}_trade_size') for q, p in ((0.25, 25), (0.75, 75), (0.9, 90), (0.95, 95)))}, {_r('avg(c)', 'mean_contracts')}, {_r('median(c)', 'median_contracts')}, count(*) AS n_trades, {_r('sum(u)', 'total_volume')} FROM s GROUP BY role"""

WIN_RATE_BY_TRADE_SIZE = f"""{POSITIONS}, s AS (SELECT power(10, floor(log10(greatest(c * price / 100.0, 0.01)) * 4) / 4.0) AS b, won, price / 100.0 AS e, c * price / 100.0 AS u FROM taker),
g AS (SELECT b, avg(won) AS wr, avg(e) AS ex, avg(won - e) AS x, var_samp(won - e) AS v, count(*) AS n, sum(u) AS vol FROM s GROUP BY b HAVING count(*) >= 10)
SELECT {_r('b', 'trade_size_bin')}, {_r('wr', 'win_rate')}, {_r('ex', 'expected_win_rate')}, {_r('x', 'excess_win_rate')}, {_r('v', 'var_excess')}, n AS n_trades, {_r('vol', 'total_volume')}, {_r('sqrt(v / n)', 'se')}, {_r('x - 1.96 * sqrt(v / n)', 'ci_lower')}, {_r('x + 1.96 * sqrt(v / n)', 'ci_upper')} FROM g"""

RETURNS_BY_HOUR = f"""{POSITIONS}, g AS (SELECT extract(hour FROM created_time) AS h, avg(won) AS wr, avg(price / 100.0) AS p, avg(won - price / 100.0) AS x, var_samp(won - price / 100.0) AS v, sum(c) AS c, sum(c * price / 100.0) AS vol, count(*) AS n FROM taker GROUP BY 1)
SELECT h AS hour_et, {_r('wr', 'win_rate')}, {_r('p', 'avg_implied_prob')}, {_r('x', 'excess_return')}, {_r('v', 'var_excess')}, {_b('c', 'total_contracts')}, {_r('vol', 'total_volume_usd')}, n AS n_trades, {_r('sqrt(v / n)', 'se')}, {_r('x - 1.96 * sqrt(v / n)', 'ci_lower')}, {_r('x + 1.96 * sqrt(v / n)', 'ci_upper')} FROM g"""

VWAP_BY_HOUR = f"""{POSITIONS}, g AS (SELECT extract(hour FROM created_time) AS h, sum(price * c) / sum(c) FILTER (price IS NOT NULL) AS w, sum(c) AS c, sum(c * price / 100.0) AS vol, count(*) AS n, avg(price) AS p, stddev_samp(price) AS s FROM taker GROUP BY 1)
SELECT h AS hour_et, {_r('w', 'vwap')}, {_b('c', 'total_contracts')}, {_r('vol', 'total_volume_usd')}, n AS n_trades, {_r('p', 'avg_price')}, {_r('s', 'std_price')}, {_r('s / sqrt(n)', 'se')}, {_r('w - 1.96 * s / sqrt(n)', 'ci_lower')}, {_r('w + 1.96 * s / sqrt(n)', 'ci_upper')} FROM g"""

VOLUME_OVER_TIME = f"WITH {TRADES} SELECT CAST(date_trunc('quarter', created_time) AS TIMESTAMP) AS quarter, {_b('sum(c)', 'volume_usd')} FROM trades GROUP BY 1"

LONGSHOT_VOLUME_SHARE = f"""{POSITIONS}, q AS (SELECT CAST(date_trunc('quarter', created_time) AS TIMESTAMP) AS quarter, price, c, c * price / 100.0 AS u FROM taker WHERE created_time IS NOT NULL), a AS (SELECT quarter, sum(u) AS total FROM q GROUP BY 1)
SELECT quarter, {_r('sum(u)', 'volume_usd')}, {_b('sum(c)', 'contracts')}, count(*) AS n_trades, {_r('any_value(total)', 'total_volume')}, {_r('sum(u) / any_value(total) * 100', 'longshot_share')} FROM q JOIN a USING (quarter) WHERE price BETWEEN 1 AND 20 GROUP BY quarter"""

PRICE_BUCKET_PIVOT = f"""{POSITIONS} SELECT CAST(date_trunc('quarter', created_time) AS TIMESTAMP) AS quarter, {', '.join(_r(f'coalesce(sum(c * price / 100.0) FILTER (price BETWEEN {a} AND {b}), 0)', f'"{a}-{b}c"') for a, b in ((1, 10), (11, 20), (21, 30), (31, 40), (41, 50), (51, 60), (61, 70), (71, 80), (81, 90), (91, 99)))} FROM taker WHERE created_time IS NOT NULL AND price BETWEEN 1 AND 99 GROUP BY 1"""

_SIDES = {"taker_yes": ("yes", "yes_price"), "taker_no": ("no", "no_price"), "maker_yes": ("no", "yes_price"), "maker_no": ("yes", "no_price")}
YES_VS_NO_BY_PRICE = f"""WITH {TRADES}, {', '.join(f"{n} AS (SELECT {p} AS price, sum(c) AS n FROM trades WHERE taker_side = '{s}' GROUP BY 1)" for n, (s, p) in _SIDES.items())},
p AS (SELECT DISTINCT price FROM ({' UNION '.join(f'SELECT price FROM {n}' for n in _SIDES)}) WHERE price BETWEEN 1 AND 99),
a AS (SELECT p.price, {', '.join(f'coalesce({n}.n, 0) AS {n}' for n in _SIDES)} FROM p {' '.join(f'LEFT JOIN {n} ON p.price = {n}.price' for n in _SIDES)}),
b AS (SELECT *, taker_yes + taker_no + maker_yes + maker_no AS total FROM a)
SELECT price, {', '.join(_b(n, n) for n in _SIDES)}, {_b('total', 'total')}, {', '.join(_r(f'{n} * 100.0 / nullif(total, 0)', f'{n}_pct') for n in _SIDES)} FROM b"""

_EV = lambda s: f"{s} AS (SELECT {s}_price AS price, sum(CASE WHEN result = '{s}' THEN c ELSE 0 END) * 1.0 / nullif(sum(c), 0) AS wr, sum(c) AS n FROM trades JOIN markets USING (ticker) WHERE result IN ('yes', 'no') AND {s}_price BETWEEN 1 AND 99 GROUP BY 1)"
EV_YES_VS_NO = f"""WITH {TRADES}, {MARKETS}, {_EV('yes')}, {_EV('no')}, a AS (SELECT CAST(s.price AS INTEGER) AS price, 100 * yes.wr - s.price AS ye, yes.wr AS yw, yes.n AS yn, 100 * no.wr - s.price AS ne, no.wr AS nw, no.n AS nn FROM (SELECT unnest(range(1, 100)) AS price) s LEFT JOIN yes ON s.price = yes.price LEFT JOIN no ON s.price = no.price)
SELECT price, {_r('ye', 'yes_ev')}, {_r('yw', 'yes_win_rate')}, {_b('yn', 'yes_contracts')}, {_r('ne', 'no_ev')}, {_r('nw', 'no_win_rate')}, {_b('nn', 'no_contracts')}, {_r('price / 100.0', 'implied_prob')}, {_r('greatest(coalesce(ye, -100), coalesce(ne, -100))', 'best_ev')}, CASE WHEN coalesce(ye, -100) > coalesce(ne, -100) THEN 'YES' ELSE 'NO' END AS best_bet FROM a"""

CALIBRATION_DEVIATION_WEEKLY = f"""WITH {TRADES}, {MARKETS}, r AS (SELECT ticker, result FROM markets WHERE result IN ('yes', 'no')), j AS (SELECT * FROM trades JOIN r USING (ticker) WHERE yes_price > 0 AND no_price > 0 AND created_time IS NOT NULL),
pos AS (SELECT created_time, {TAKER_PRICE} AS price, {TAKER_WON} AS won FROM j UNION ALL SELECT created_time, {MAKER_PRICE}, {MAKER_WON} FROM j), p AS (SELECT * FROM pos WHERE price BETWEEN 1 AND 99),
b AS (SELECT min(created_time) AS lo, max(created_time) AS hi FROM p), w AS (SELECT unnest(generate_series(lo + to_days(CAST((7 - dayofweek(lo)) % 7 AS INTEGER)), hi, INTERVAL 7 DAY)) AS date FROM b),
g AS (SELECT date, price, count(*) AS n, 100.0 * sum(won) / count(*) AS wr FROM w JOIN p ON p.created_time <= w.date GROUP BY 1, 2)
SELECT CAST(date AS TIMESTAMP) AS date, {_r('avg(abs(wr - price))', 'mean_absolute_deviation')} FROM g GROUP BY date HAVING sum(n) >= 1000"""

_CATEGORIES = f"WITH {MARKETS}, cats AS (SELECT {CAT} AS cat, sum(coalesce(volume, 0)) AS v, count(*) AS n FROM markets GROUP BY 1)"
MARKET_TYPES = f'{_CATEGORIES} SELECT {WHICH("group")} AS "group", {_b("sum(v)", "total_volume")}, {_b("sum(n)", "market_count")} FROM cats GROUP BY 1'
MARKET_TYPES_ROLLUP = f"""{_CATEGORIES}, k AS (SELECT {WHICH('group')} AS g, {WHICH('category')} AS c, {WHICH('subcategory')} AS s, v FROM cats),
l1 AS (SELECT g, sum(v) AS v FROM k GROUP BY 1), l2 AS (SELECT g, c, sum(v) AS v FROM k GROUP BY 1, 2), l3 AS (SELECT g, c, s, sum(v) AS v FROM k GROUP BY 1, 2, 3),
u AS (SELECT 1 AS level, g, NULL AS c, NULL AS s, v, (SELECT sum(v) FROM k) AS w FROM l1 UNION ALL SELECT 2, l2.g, l2.c, NULL, l2.v, l1.v FROM l2 JOIN l1 USING (g) UNION ALL SELECT 3, l3.g, l3.c, l3.s, l3.v, l2.v FROM l3 JOIN l2 ON l3.g = l2.g AND l3.c = l2.c)
SELECT level, g AS "group", c AS category, s AS subcategory, {_b('v', 'volume')}, {_r('v / w', 'share')} FROM u WHERE v >= 0.01 * w"""
CATEGORY_TOP_N_OTHER = f"""{_CATEGORIES}, k AS (SELECT {WHICH('group')} AS "group", cat, v, row_number() OVER (PARTITION BY {WHICH('group')} ORDER BY v DESC, cat) AS n FROM cats)
SELECT "group", CASE WHEN n <= 8 THEN cat ELSE 'Other' END AS name, {_b('sum(v)', 'volume')} FROM k GROUP BY 1, 2"""

META_STATS = f"""WITH {TRADES}, {MARKETS}, t AS (SELECT count(*) AS a, sum(c) AS b, count(DISTINCT ticker) AS d FROM trades), m AS (SELECT count(*) AS e, count(DISTINCT event_ticker) AS f FROM markets)
SELECT 'num_trades' AS metric, round(CAST(a AS DOUBLE), 6) AS value, format('{{:,}}', a) AS formatted FROM t UNION ALL SELECT 'num_trades_millions', round(a / 1e6, 6), printf('%.1f', a / 1e6) FROM t
UNION ALL SELECT 'total_volume', CAST(b AS DOUBLE), format('{{:,}}', CAST(b AS BIGINT)) FROM t UNION ALL SELECT 'total_volume_billions', round(b / 1e9, 6), printf('%.2f', b / 1e9) FROM t
UNION ALL SELECT 'num_markets', CAST(e AS DOUBLE), format('{{:,}}', e) FROM m UNION ALL SELECT 'num_events', CAST(f AS DOUBLE), format('{{:,}}', f) FROM m UNION ALL SELECT 'num_tickers_from_trades', CAST(d AS DOUBLE), format('{{:,}}', d) FROM t"""

SQL = {k.lower(): v for k, v in list(globals().items()) if k.isupper() and isinstance(v, str) and k not in {"TRADES", "MARKETS", "RESOLVED", "TAKER_PRICE", "MAKER_PRICE", "TAKER_WON", "MAKER_WON", "CAT", "BASE", "TAKER", "MAKER", "POSITIONS", "BETS"} and not k.startswith("_")}
