"""Categories of event tickers and their ordered first-match classification."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import cycle

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    group: str
    category: str
    subcategory: str


#: Colour of each group in charts, in hexadecimal; groups of other rules get the next free colour (:func:`group_colors`).
# The groups and colours that charts are recognised by.
GROUP_COLORS = {
    "Sports": "#1f77b4", "Politics": "#d62728", "Crypto": "#ff7f0e", "Finance": "#2ca02c", "Science/Tech": "#9467bd", "Weather": "#17becf",
    "Entertainment": "#e377c2", "Media": "#bcbd22", "World Events": "#8c564b", "Esports": "#7f7f7f", "Other": "#aaaaaa",
}
SPARE_COLORS = ("#393b79", "#637939", "#8c6d31", "#843c39", "#7b4173", "#3182bd", "#e6550d", "#31a354")


def group_colors(groups: Iterable[str]) -> dict[str, str]:
    """A colour for each group: its own, else the spare ones in name order."""
    spare = cycle(SPARE_COLORS)
    return {g: GROUP_COLORS[g] if g in GROUP_COLORS else next(spare) for g in sorted(set(groups))}


#: Rules by group and category: patterns of series names.  The first lines fit the series of the test data, the others common
#: names of leagues, offices, coins, indexes, places and prizes.  A file replaces them all (see :func:`load_rules`).
DEFAULT_RULES = tuple(
    Rule(pattern, group, category, pattern.title())
    for group, category, patterns in (
        ("Weather", "Water", ("TIDE", "RESLVL")), ("Weather", "Climate", ("SNOW", "HEAT")),
        ("Transport", "Crossings", ("FERRY", "BRIDGE")), ("Transport", "Lines", ("TRAM", "SKYRAIL", "CABLE", "SAT")),
        ("Sports", "Races", ("REGATTA", "SLED")), ("Sports", "Matches", ("CHESS", "LANTGM", "GULLS", "ROOKS")),
        ("Finance", "Prices", ("RENT", "SALT", "GRN", "PWR")), ("Finance", "Prizes", ("JACK",)),
        ("Politics", "Councils", ("COUNCIL",)), ("Culture", "Awards", ("FILM", "BAKE")),
        ("Esports", "Games", ("LEAGUEOFLEGENDS", "DOTA", "VALORANT", "CSGO", "CS2")),
        ("Sports", "American football", ("NFL", "NCAAF", "SUPERBOWL")), ("Sports", "Basketball", ("WNBA", "NBA", "NCAAMB", "NCAAWB", "MARMAD")),
        ("Sports", "Baseball", ("MLB", "WORLDSERIES")), ("Sports", "Ice hockey", ("NHL", "STANLEYCUP")),
        ("Sports", "Football", ("EPL", "UEFA", "UCL", "LALIGA", "BUNDESLIGA", "SERIEA", "LIGUE1", "MLS", "FIFA", "WORLDCUP")),
        ("Sports", "Tennis", ("ATP", "WTA", "WIMBLEDON", "USOPEN")), ("Sports", "Golf", ("PGA", "MASTERS", "RYDER")),
        ("Sports", "Fights", ("UFC", "BOXING")), ("Sports", "Motor", ("NASCAR", "FORMULA1", "INDYCAR")), ("Sports", "Games", ("OLYMPIC",)),
        ("Crypto", "Coins", ("BTC", "ETHUSD", "KXETH", "SOLUSD", "DOGE", "XRP", "BITCOIN")),
        ("Finance", "Indexes", ("INX", "NASDAQ", "SPX", "DOW", "NIKKEI", "DAX", "FTSE")), ("Finance", "Rates", ("FED", "TNOTE", "MORTGAGE", "ECB", "BOE")),
        ("Finance", "Economy", ("CPI", "PCE", "GDP", "PAYROLL", "JOBLESS", "UNEMP", "RECESSION", "DEBT", "TARIFF")),
        ("Finance", "Currencies", ("EURUSD", "USDJPY", "GBPUSD")), ("Finance", "Commodities", ("WTI", "BRENT", "OIL", "GAS", "GOLD", "SILVER", "EGG")),
        ("Politics", "Elections", ("PRES", "POTUS", "SENATE", "HOUSE", "GOVERNOR", "MAYOR", "PRIMARY", "ELECT", "NOMINEE")),
        ("Politics", "Institutions", ("SCOTUS", "CABINET", "SPEAKER", "SHUTDOWN", "VETO", "IMPEACH", "APPROVAL", "EXECORDER")),
        ("World Events", "Conflicts", ("UKRAINE", "GAZA", "ISRAEL", "TAIWAN", "CEASEFIRE", "NATO")), ("World Events", "Persons", ("POPE", "NOBEL")),
        ("Weather", "Temperature", ("HIGHNY", "HIGHCHI", "HIGHMIA", "HIGHAUS", "HIGHLAX", "HIGHDEN", "TEMP")),
        ("Weather", "Storms", ("HURRICANE", "TORNADO", "RAIN", "HURC")),
        ("Science/Tech", "Space", ("SPACEX", "STARSHIP", "NASA", "MOON")), ("Science/Tech", "Companies", ("OPENAI", "TESLA", "APPLE", "NVDA", "GPT", "LLM")),
        ("Science/Tech", "Health", ("COVID", "MEASLES", "FLU", "FDA")),
        ("Entertainment", "Awards", ("OSCAR", "GRAMMY", "EMMY", "TONY", "GOLDENGLOBE")),
        ("Entertainment", "Charts", ("SPOTIFY", "BILLBOARD", "NETFLIX", "BOXOFFICE", "ROTTEN")), ("Media", "Speech", ("MENTION", "SAYS", "TWEET")),
    ) for pattern in patterns
)


def load_rules(path: str) -> tuple[Rule, ...]:
    """Rules from a CSV with the columns pattern, group, category, subcategory; the order counts."""
    with open(path, encoding="utf-8", newline="") as f:
        return tuple(Rule(r["pattern"], r["group"], r["category"], r["subcategory"]) for r in csv.DictReader(f))


def category(event_ticker: Column | str, guard: bool = True) -> Column:
    """The leading run of capitals and digits; ``independent`` for null, blank and (with ``guard``) no match."""
    c = F.col(event_ticker) if isinstance(event_ticker, str) else event_ticker
    head = F.regexp_extract(c, "^([A-Z0-9]+)", 1)
    none = c.isNull() | (c == "")
    return F.when(none | (head == "") if guard else none, "independent").otherwise(head)


def classify(c: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """``struct(group, category, subcategory)`` of the first rule whose pattern the upper-cased name holds.

    Without a match: ("Other", "Other", name).  Apply it to distinct categories: cost grows with the rules.
    """
    lit = lambda g, k, s: F.struct(F.lit(g).alias("group"), F.lit(k).alias("category"), s.alias("subcategory"))
    name = F.upper(c)
    out = None
    for r in rules:
        hit, value = F.contains(name, F.lit(r.pattern)), lit(r.group, r.category, F.lit(r.subcategory))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    other = lit("Other", "Other", c)
    return other if out is None else out.otherwise(other)
