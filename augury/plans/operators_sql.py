"""SQL twins of the statistics and of the single operators."""

from __future__ import annotations

from augury.plans.training_sql import _id, _ticker
from augury.plans.venue_k_sql import (
    BASE, BETS, CAT, EV_YES_VS_NO, MAKER_PRICE, MAKER_VS_TAKER_RETURNS, MARKETS, TAKER, TRADES, WHICH, _b, _r, priced_trades
)
from augury.plans.venue_p_sql import MARKETS as P_MARKETS
from augury.plans.venue_p_sql import FILLS, TIMES

_TK = f"{BASE}, {TAKER}"
_RANGE = lambda x, k: f"CASE WHEN hi > lo THEN least(greatest(ceil(({x} - lo) / ((hi - lo) / {k}.0::DOUBLE)), 1), {k}) ELSE {(k + 1) // 2} END"

MANN_WHITNEY_U = f"""{_TK}, s AS (SELECT price, c * price AS t, c * ({MAKER_PRICE}) AS m FROM taker WHERE yes_price IS NOT NULL AND no_price IS NOT NULL AND c IS NOT NULL), r AS (SELECT min(price)::DOUBLE AS lo, max(price)::DOUBLE AS hi FROM s),
b AS (SELECT CAST({_RANGE('price', 10)} AS INTEGER) AS bin, t, m FROM s, r), v AS (SELECT bin, 0 AS g, t AS v FROM b UNION ALL SELECT bin, 1, m FROM b),
k AS (SELECT bin, g, v, rank() OVER (PARTITION BY bin ORDER BY v) + (count(*) OVER (PARTITION BY bin, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY bin, v) AS ties FROM v),
u AS (SELECT bin, sum(rk) FILTER (g = 1)::DOUBLE AS r1, count(*) FILTER (g = 1) AS n, sum(ties::DOUBLE * ties - 1) AS tie, avg(v) FILTER (g = 0) AS ta, avg(v) FILTER (g = 1) AS ma, median(v) FILTER (g = 0) AS td, median(v) FILTER (g = 1) AS md FROM k GROUP BY 1 HAVING count(*) FILTER (g = 1) >= 100),
w AS (SELECT *, r1 - n * (n + 1) / 2.0::DOUBLE AS us FROM u)
SELECT ((bin - 1) * 10 + 1) || '-' || bin * 10 || 'c' AS price_bin, {_r('ta / 100', 'taker_mean')}, {_r('ma / 100', 'maker_mean')}, {_r('td / 100', 'taker_median')}, {_r('md / 100', 'maker_median')}, {_r('ma / ta', 'ratio')}, us AS u_statistic,
{_r('(us - n * n / 2.0::DOUBLE - 0.5) / sqrt(n::DOUBLE * n / 12 * ((2 * n + 1) - tie / (2.0::DOUBLE * n * (2 * n - 1))))', 'z')}, {_r('1 - 2 * us / (n::DOUBLE * n)', 'effect_size_r')}, n AS n_trades, ma > ta AS maker_larger FROM w"""

TWO_PROPORTION_Z = f"""{_TK}, g AS (SELECT price, count(*) FILTER (taker_side = 'yes') AS yt, count(*) FILTER (taker_side = 'no') AS nt, sum(c) FILTER (taker_side = 'yes') AS yn, sum(c) FILTER (taker_side = 'no') AS nn,
 sum(c * won) FILTER (taker_side = 'yes') AS yw, sum(c * won) FILTER (taker_side = 'no') AS nw FROM taker WHERE price IN (1,2,3,4,5,10,15,20,25,50,75,80,85,90,95,96,97,98,99) GROUP BY 1),
h AS (SELECT price, yn, nn, yw::DOUBLE / yn AS y, nw::DOUBLE / nn AS n, (yw + nw)::DOUBLE / (yn + nn) AS p FROM g WHERE yt >= 100 AND nt >= 100), i AS (SELECT *, sqrt(p * (1 - p) * (1.0::DOUBLE / yn + 1.0::DOUBLE / nn)) AS se FROM h)
SELECT price, {_r('y', 'yes_win_rate')}, {_r('n', 'no_win_rate')}, {_r('(n - y) * 100', 'diff_pp')}, {_r('(y * 100 - price) / price * 100', 'yes_ev')}, {_r('(n * 100 - price) / price * 100', 'no_ev')}, {_r('(n - y) * 100 / price * 100', 'ev_diff')}, {_r('CASE WHEN se > 0 THEN (n - y) / se ELSE 0 END', 'z_statistic')}, {_b('yn', 'yes_n')}, {_b('nn', 'no_n')}, n > y AS no_better FROM i"""


TWO_PROPORTION_Z_SMALL = TWO_PROPORTION_Z.replace("yt >= 100 AND nt >= 100", "yt >= 10 AND nt >= 10")


def _welch(a: str, b: str) -> str:
    t = f"({a}m - {b}m) / sqrt({a}v / {a}n + {b}v / {b}n)"
    df = f"power({a}v / {a}n + {b}v / {b}n, 2) / (power({a}v / {a}n, 2) / ({a}n - 1) + power({b}v / {b}n, 2) / ({b}n - 1))"
    d = f"({a}m - {b}m) / sqrt((({a}n - 1) * {a}v + ({b}n - 1) * {b}v) / ({a}n + {b}n - 2))"
    return f"{_r(t, 't_statistic')}, {_r(df, 'df')}, {_r(d, 'cohens_d')}"


WELCH_AND_COHENS_D = f"""{_TK}, e AS (SELECT {CAT} AS cat, won - price / 100.0 AS x FROM taker), g AS (SELECT {WHICH('group')} AS g, count(x)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS v FROM e GROUP BY 1),
p AS (SELECT b.g, a.n AS an, a.m AS am, a.v AS av, b.n AS bn, b.m AS bm, b.v AS bv FROM g b, g a WHERE a.g = 'Finance' AND b.g <> 'Finance' AND b.n >= 100)
SELECT 'Finance vs ' || g AS comparison, {_r('am * 100', 'finance_mean')}, {_r('bm * 100', 'other_mean')}, {_r('(am - bm) * 100', 'diff_pp')}, {_welch('a', 'b')}, {_b('an', 'finance_n')}, {_b('bn', 'other_n')} FROM p"""

PEARSON_SPEARMAN = f"""{_TK}, s AS (SELECT log10(greatest(c * price / 100.0::DOUBLE, 0.01)) AS l, greatest(c * price, 1) AS z, won - price / 100.0 AS x FROM taker WHERE c IS NOT NULL AND price IS NOT NULL),
k AS (SELECT l, x, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS b FROM s)
SELECT {_r('corr(l, x)', 'pearson_r')}, {_r('corr(a, b)', 'spearman_r')}, count(*) AS n FROM k"""

WLS_BINNED_REGRESSION = f"""{_TK}, s AS (SELECT log10(greatest(c * price / 100.0::DOUBLE, 0.01::DOUBLE)) AS l, won - price / 100.0 AS x FROM taker WHERE c IS NOT NULL AND price IS NOT NULL), r AS (SELECT min(l) AS lo, max(l) AS hi FROM s),
b AS (SELECT {_RANGE('l', 20)} AS bin, count(*) AS n, avg(x) AS y, avg(l) AS x FROM s, r GROUP BY 1), f AS (SELECT (sum(n) * sum(n * x * y) - sum(n * x) * sum(n * y)) / (sum(n) * sum(n * x * x) - sum(n * x) * sum(n * x)) AS m, sum(n * y) AS sy, sum(n * x) AS sx, sum(n) AS s, sum(sqrt(n) * y) / sum(sqrt(n)) AS ym FROM b)
SELECT {_r('any_value(m) * 100', 'slope_pp_per_log10')}, {_r('1 - sum(sqrt(n) * power(y - (m * x + (sy - m * sx) / s), 2)) / sum(sqrt(n) * power(y - ym, 2))', 'r_squared')} FROM b, f"""

_SIDE = lambda s: f"{s} AS (SELECT r, count(*) AS t, sum(c * x) / sum(c) * 100 AS e, sum(w) AS n, sum(w * x) / sum(w) AS m, (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) / (sum(w) - 1) AS v FROM k WHERE side = '{s}' GROUP BY 1 HAVING count(*) >= 100)"
MAKER_DIRECTION_TEST = f"""{BETS}, k AS (SELECT side, c::DOUBLE AS c, least(c, 100)::DOUBLE AS w, (won - price / 100.0)::DOUBLE AS x, CASE WHEN price <= 10 THEN '1-10c' WHEN price <= 25 THEN '11-25c' WHEN price <= 50 THEN '26-50c' WHEN price <= 75 THEN '51-75c' WHEN price <= 90 THEN '76-90c' ELSE '91-99c' END AS r FROM bets WHERE price BETWEEN 1 AND 99),
{_SIDE('yes')}, {_SIDE('no')}, j AS (SELECT r, yes.t AS yt, no.t AS nt, yes.e AS ye, no.e AS ne, no.n AS an, no.m AS am, no.v AS av, yes.n AS bn, yes.m AS bm, yes.v AS bv FROM yes JOIN no USING (r))
SELECT r AS price_range, {_r('ye', 'yes_excess_pp')}, {_r('ne', 'no_excess_pp')}, {_r('ne - ye', 'diff_pp')}, {_welch('a', 'b')}, yt AS yes_n, nt AS no_n, ne > ye AS no_better FROM j"""

# Two-sided p of a normal z, by the series of the error function whose terms are all positive.
_P = lambda z: f"""(1 - CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 0 WHEN abs({z}) > 8 THEN 1 ELSE least(1, 2 / sqrt(pi()) * list_sum(list_transform(range(0, 250), lambda n: exp((2 * n + 1) * ln(abs({z}) / sqrt(2.0::DOUBLE)) + 2 * n * ln(2.0::DOUBLE) - lgamma(2.0::DOUBLE * n + 2) + lgamma(n + 1.0::DOUBLE) - {z} * {z} / 2)))) END)"""
P_VALUES = f"SELECT *, round({_P('taker_z')}, 9) AS taker_p, round({_P('maker_z')}, 9) AS maker_p FROM ({MAKER_VS_TAKER_RETURNS})"
# |t| from which p is below 0.05, by its expansion around the normal quantile.
_Z = 1.959963984540054
_T = f"({_Z} + {(_Z**3 + _Z) / 4} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / (df * df) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / (df * df * df))"
_METRIC = lambda test, metric, value, src: f"SELECT '{test}' AS test, '{metric}' AS metric, {_r(value, 'value')} FROM {src}"
_CORR_P = lambda r: _P(f"({r} * sqrt((n - 2) / (1 - {r} * {r})) * (1 - 0.25 / (n - 2)) / sqrt(1 + {r} * {r} / (1 - {r} * {r}) / 2))")
STATISTICAL_TESTS = f"""WITH s AS ({MANN_WHITNEY_U}), y AS ({TWO_PROPORTION_Z}), g AS ({WELCH_AND_COHENS_D}), c AS (SELECT * FROM ({PEARSON_SPEARMAN}), ({WLS_BINNED_REGRESSION})), m AS ({MAKER_DIRECTION_TEST})
{' UNION ALL '.join((
    _METRIC('trade_size_consistency', 'bins_maker_larger', 'count(*) FILTER (maker_larger)', 's'), _METRIC('trade_size_consistency', 'bins_total', 'count(*)', 's'),
    _METRIC('trade_size_consistency', 'bins_significant_p05', 'count(*) FILTER (z > 1.6448536269514722)', 's'), _METRIC('trade_size_consistency', 'overall_ratio', 'avg(ratio)', 's'),
    _METRIC('yes_no_asymmetry', 'prices_no_better', 'count(*) FILTER (no_better)', 'y'), _METRIC('yes_no_asymmetry', 'prices_total', 'count(*)', 'y'),
    _METRIC('yes_no_asymmetry', 'prices_significant', f'count(*) FILTER (abs(z_statistic) > {_Z})', 'y'), _METRIC('yes_no_asymmetry', 'avg_ev_diff', 'avg(ev_diff)', 'y'),
    _METRIC('category_comparisons', 'all_significant_vs_finance', f'count(*) FILTER (abs(t_statistic) > {_T})', 'g'), _METRIC('category_comparisons', 'total_comparisons', 'count(*)', 'g'),
    _METRIC('category_comparisons', 'max_cohens_d', 'max(abs(cohens_d))', 'g'),
    *(_METRIC('trade_size_regression', x, x, 'c') for x in ('pearson_r', 'spearman_r', 'slope_pp_per_log10', 'r_squared')),
    _METRIC('trade_size_regression', 'pearson_p', _CORR_P('pearson_r'), 'c'), _METRIC('trade_size_regression', 'spearman_p', _CORR_P('spearman_r'), 'c'),
    _METRIC('maker_direction', 'ranges_no_better', 'count(*) FILTER (no_better)', 'm'), _METRIC('maker_direction', 'ranges_total', 'count(*)', 'm'),
    _METRIC('maker_direction', 'ranges_significant', f'count(*) FILTER (abs(t_statistic) > {_T})', 'm'),
))}"""

MAKER_COUNTERPARTY_LOOKUP = f"WITH r AS ({MAKER_VS_TAKER_RETURNS}) SELECT a.price, a.taker_excess, coalesce(b.maker_excess, 0) AS counterparty_excess FROM r a LEFT JOIN r b ON b.price = 100 - a.price"
CATEGORY_EXTRACT = f"WITH {MARKETS} SELECT {CAT} AS category, CASE WHEN event_ticker IS NULL OR event_ticker = '' THEN 'independent' ELSE regexp_extract(event_ticker, '^([A-Z0-9]+)', 1) END AS unguarded, count(*) AS n FROM markets GROUP BY 1, 2"
CLASSIFIER_FIRST_MATCH = f"""WITH {MARKETS}, c AS (SELECT DISTINCT {CAT} AS cat FROM markets) SELECT cat AS name, {WHICH('group')} AS "group", {WHICH('category')} AS category, {WHICH('subcategory')} AS subcategory FROM c"""
JSON_RESOLUTION = f"WITH {P_MARKETS} SELECT token_id, won FROM tok"
COMPUTED_KEY_JOIN = f"WITH {P_MARKETS} SELECT won, count(*) AS n, count(DISTINCT token_id) AS n_tokens FROM p_trades JOIN tok ON CASE WHEN maker_asset_id = '0' THEN taker_asset_id ELSE maker_asset_id END = token_id GROUP BY 1"
LOWER_KEY_JOIN = f"WITH {P_MARKETS}, a AS (SELECT address, arg_max(winner, id) AS winner FROM res WHERE winner IS NOT NULL AND address IS NOT NULL GROUP BY 1) SELECT winner, outcome_index, count(*) AS n FROM p_legacy JOIN a ON {_id('fpmm_address')} = address GROUP BY 1, 2"
COUNTERPARTY_PRICE_ROUND = f"WITH {FILLS}, c AS (SELECT 100.0::DOUBLE * maker_amount::DOUBLE / taker_amount::DOUBLE AS c FROM fills WHERE maker_amount > 0 AND taker_amount > 0 AND maker_asset_id = '0') SELECT round(c) AS price, round(100.0::DOUBLE - c) AS complement, count(*) AS n FROM c WHERE round(c) BETWEEN 0 AND 100 GROUP BY 1, 2"
DECILE_CALIBRATION = f"{_TK} SELECT CAST(floor(price / 10) * 10 AS BIGINT) AS bucket_low, count(*) AS n, {_b('sum(won)', 'wins')}, {_r('avg(price)', 'mean_predicted')} FROM taker WHERE price BETWEEN 1 AND 99 GROUP BY 1"
TIME_BUCKET_JOIN = f"WITH {TIMES} SELECT strftime(seen, '%Y-%m') AS month, count(*) AS n FROM p_trades JOIN bt ON block_number // 10800 = bucket GROUP BY 1"
EVENTS_PER_BLOCK_UNION = "SELECT block_number, count(*) AS n FROM (SELECT block_number FROM p_trades UNION ALL SELECT block_number FROM p_legacy) GROUP BY 1"
USDC_SEMI_JOIN = f"WITH {P_MARKETS} SELECT {_id('fpmm_address')} AS fpmm_address, count(*) AS n FROM p_legacy WHERE {_id('fpmm_address')} IN (SELECT address FROM usdc) GROUP BY 1"
DEDUPE_KEEP_FIRST = f"SELECT {_ticker('ticker')} AS ticker, status, result, _fetched_at FROM k_markets WHERE {_ticker('ticker')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_ticker('ticker')} ORDER BY _fetched_at NULLS LAST, status NULLS LAST, result NULLS LAST) = 1"
ASOF_LATEST = f"""WITH m AS (SELECT {_ticker('ticker')} AS k, _fetched_at AS seen, min(status) AS status FROM k_markets GROUP BY 1, 2), t AS (SELECT {_ticker('ticker')} AS k, _fetched_at AS seen FROM k_trades WHERE {_ticker('ticker')} IS NOT NULL)
SELECT coalesce(m.status, 'unknown') AS status, count(*) AS n FROM t ASOF LEFT JOIN m ON t.k = m.k AND t.seen >= m.seen GROUP BY 1"""
BLOCK_TIME_INTERPOLATION = """WITH s AS (SELECT block_number AS b, min(epoch(CAST(replace(replace(timestamp, 'Z', ''), '+00:00', '') AS TIMESTAMP)))::BIGINT AS s FROM p_blocks GROUP BY 1), n AS (SELECT b, s, lead(b) OVER (ORDER BY b) AS nb, lead(s) OVER (ORDER BY b) AS ns FROM s),
e AS (SELECT unnest(range(b, nb)) AS block_number, b, s, nb, ns FROM n WHERE nb IS NOT NULL), a AS (SELECT block_number, s + (ns - s) * (block_number - b) // (nb - b) AS t FROM e UNION ALL SELECT b, s FROM n WHERE nb IS NULL)
SELECT block_number // 100000 AS part, count(*) AS n_blocks, strftime(make_timestamp(min(t) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS first_time, strftime(make_timestamp(max(t) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS last_time, CAST(sum(t) AS BIGINT) AS total FROM a GROUP BY 1"""
EQUAL_WIDTH_BINS = f"WITH o AS (SELECT o_totalprice::DOUBLE AS x FROM orders), r AS (SELECT min(x) AS lo, max(x) AS hi FROM o) SELECT CAST({_RANGE('x', 20)} AS INTEGER) AS bin, count(*) AS n FROM o, r GROUP BY 1"
OPTIONAL_SOURCE_UNION = "SELECT src, count(*) AS n FROM (SELECT 'p_trades' AS src FROM p_trades UNION ALL SELECT 'p_legacy' FROM p_legacy) GROUP BY 1"
JSON_MAP_LOOKUP = "SELECT key, value, count(*) AS n FROM (SELECT k AS key, json_extract_string(props, k) AS value FROM (SELECT props, unnest(json_keys(props)) AS k FROM events)) GROUP BY 1, 2"
DISTINCT_UNION_PRICES = f"WITH {TRADES} SELECT price FROM (SELECT yes_price AS price FROM trades UNION SELECT no_price FROM trades) WHERE price BETWEEN 1 AND 99"
QUARTER_LABELS = f"""WITH {TRADES}, q AS (SELECT year(created_time) AS y, quarter(created_time) AS q, sum(c) AS n FROM trades WHERE created_time IS NOT NULL GROUP BY 1, 2)
SELECT y || ' Q' || q AS quarter, 'Q' || q || ' ''' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS short, {_b('n', 'contracts')}, {_r('n / sum(n) OVER (PARTITION BY y)', 'year_share')} FROM q"""
FILL_ATTRIBUTES = f"""WITH {FILLS}, f AS (SELECT CASE WHEN maker_asset_id = '0' THEN 'BUY' ELSE 'SELL' END AS side, (CASE WHEN maker_asset_id = '0' THEN maker_amount ELSE taker_amount END)::DOUBLE AS u, (CASE WHEN maker_asset_id = '0' THEN taker_amount ELSE maker_amount END)::DOUBLE AS t FROM fills WHERE maker_amount > 0 AND taker_amount > 0)
SELECT side, count(*) AS n, round(max(u / t), 4) AS max_price, CAST(sum(CAST(floor(t / 1e6) AS HUGEINT)) AS VARCHAR) AS tokens FROM f GROUP BY 1"""
ARG_EXTREMES = f"WITH e AS ({EV_YES_VS_NO}) SELECT {', '.join(f'(SELECT price FROM e WHERE {s}_ev IS NOT NULL ORDER BY {s}_ev {o}, price LIMIT 1) AS {n}_{s}' for s in ('yes', 'no') for n, o in (('best', 'DESC'), ('worst', 'ASC')))}"
TOP_K_EVENTS = f"WITH {MARKETS} SELECT event_ticker, {_b('sum(volume)', 'volume')}, count(*) AS n_markets FROM markets WHERE event_ticker IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 8"
RANKS_WITHIN_GROUP = f"""WITH {MARKETS}, c AS (SELECT {CAT} AS cat, sum(coalesce(volume, 0)) AS v FROM markets GROUP BY 1), g AS (SELECT {WHICH('group')} AS "group", cat, v FROM c)
SELECT "group", cat AS name, CAST(row_number() OVER (PARTITION BY "group" ORDER BY v DESC, cat) - 1 AS INTEGER) AS pos, count(*) OVER (PARTITION BY "group") AS size FROM g"""
STREAM_EQUALS_BATCH = f"WITH {priced_trades('trades', 'SELECT * FROM k_trades')} SELECT yes_price AS price, count(*) AS n, {_b('sum(c)', 'contracts')} FROM trades GROUP BY 1"
ADDRESS_PREFIXES = f"SELECT substr(t, 3, 1) AS digit, count(DISTINCT t) AS n FROM (SELECT {_id('trader')} AS t FROM p_legacy) WHERE t LIKE '0x%' GROUP BY 1"

SQL = {k.lower(): v for k, v in list(globals().items()) if k.isupper() and isinstance(v, str) and k not in {"BASE", "BETS", "CAT", "EV_YES_VS_NO", "MAKER_VS_TAKER_RETURNS", "MARKETS", "TAKER", "TRADES", "P_MARKETS", "TIMES", "FILLS", "MAKER_PRICE"} and not k.startswith("_")}
