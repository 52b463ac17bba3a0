"""One unit per quantity: named units, defaults of the source, number texts, and log-scale mixtures.

A unit is a power of ten to the target scale.  It comes from the first of: the name in a note or in the
value's own text, the default of the feed or contract, a mixture fitted on the log scale.  The mixture's
components share one shape and are offset by the known powers; expectation-maximisation runs on a
histogram of all rows (bounded by the bins of the log scale).  Other evidence about a row, such as two
prices that make a dollar in one unit only, enters the likelihood of each component, beside a flat
component for rows that no unit explains.  Each row gets the most probable unit and its posterior; below
``SURE`` the row is flagged.

Which of the unit names in a note is about the quantity is learnt from all notes: the clause around a
name, without the name, is its context, and a context that often names a unit against the evidence in its
rows is about something else.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_TABLE_MOST = 100_000
#: Posterior from which a unit counts as sure.
SURE = 0.99
#: Share of rows that no unit explains, spread evenly over so many decades, and of rows that break the evidence of their unit.
NO_UNIT, DECADES, AGAINST = 1e-3, 10.0, 1e-6
#: Contexts of unit names are told apart by so many slots; share of contexts that are about the quantity before any evidence,
#: and of rows in which such a context names the right unit.
CONTEXT_SLOTS = 4096
ABOUT_IT, NAMES_RIGHT = 0.9, 0.99


@dataclass(frozen=True)
class UnitTable:
    """Units of one field: ``names`` by lower-case name, ``defaults`` by source; powers of ten."""

    names: dict[str, int]
    defaults: dict[str, int]

    @classmethod
    def load(cls, defs: DataFrame, table: str, field: str) -> UnitTable:
        """Reads the fixed table ``unit_defs``; its size is checked before it comes to the driver."""
        rows = defs.where(
            (F.col("tbl") == table) & (F.col("field_name") == field)
        ).select("unit_name", "source", "pow10").limit(UNIT_TABLE_MOST + 1).collect()
        if len(rows) > UNIT_TABLE_MOST:
            raise ValueError(f"unit_defs has more than {UNIT_TABLE_MOST} rows for {table}.{field}")
        return cls({r[0].lower(): r[2] for r in rows if r[1] is None and r[0]}, {r[1]: r[2] for r in rows if r[1] is not None})

    @property
    def powers(self) -> list[int]:
        return sorted({*self.names.values(), *self.defaults.values()})

    def pattern(self) -> str:
        """Matches any unit name as whole words, the longest first."""
        one = lambda n: (r"(?<![\p{L}\p{N}])" if n[0].isalnum() else "") + re.escape(n) + (r"(?![\p{L}\p{N}])" if n[-1].isalnum() else "")
        return "(?iu)(" + "|".join(one(n) for n in sorted(self.names, key=lambda n: (-len(n), n))) + ")"

    def power_of(self, name: Column, of: dict[str, int]) -> Column:
        if not of:
            return F.lit(None).cast("int")
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(of.items()) for x in kv)), name)

    def mentions(self, note: Column) -> Column:
        """The unit names in a note as ``array<struct<power, slot>>``; ``slot`` stands for the clause around the name.

        Clauses end at ``/ , ;``; the first name in a clause counts.
        """
        if not self.names:
            return F.lit(None).cast("array<struct<power: int, slot: int>>")

        def one(clause: Column) -> Column:
            context = F.btrim(F.regexp_replace(clause, self.pattern(), "\x00"), F.lit(" \t"))
            power = self.power_of(F.regexp_extract(clause, self.pattern(), 1), self.names)
            return F.struct(power.alias("power"), F.pmod(F.xxhash64(context), F.lit(CONTEXT_SLOTS)).cast("int").alias("slot"))

        return F.filter(F.transform(F.split(F.lower(note), "[/,;]"), one), lambda m: m["power"].isNotNull())

    def named(self, note: Column, others: Sequence[int] = ()) -> Column:
        """The power of the first unit that a note names in a clause that is not one of ``others``; null if it names none."""
        found = self.mentions(note)
        if others:
            found = F.filter(found, lambda m: ~m["slot"].isin(*others))
        return F.get(found, F.lit(0))["power"]

    def default(self, source: Column) -> Column:
        return self.power_of(source, self.defaults)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, so that expressions do not grow with each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shift_text(number: Column, power: Column) -> Column:
    """``number * 10^power`` as text of a whole number, for texts of any length.

    ``number`` is plain digits with an optional sign and fraction.  Digits below one are rounded half up.
    Null where either is null.
    """
    parts = F.struct(
        F.when(number.startswith("-"), "-").otherwise("").alias("sign"), F.regexp_extract(number, r"^[+-]?(\d*)", 1).alias("whole"),
        F.regexp_extract(number, r"\.(\d*)$", 1).alias("part"), power.cast("int").alias("p"),
    )

    def shifted(v: Column) -> Column:
        up = F.struct(
            F.concat(v["whole"], F.rpad(F.substring(v["part"], F.lit(1), v["p"]), v["p"], "0")).alias("d"),
            F.substring(v["part"], v["p"] + 1, F.lit(1)).alias("after"),
            v["sign"].alias("sign")
        )

        def down(w: Column) -> Column:
            cut = F.length(w) + v["p"]
            return F.struct(
                F.substring(w, F.lit(1), cut).alias("d"), F.substring(w, cut + 1, F.lit(1)).alias("after"), v["sign"].alias("sign")
            )

        return F.when(v["p"] >= 0, up).otherwise(let(F.lpad(v["whole"], F.greatest(F.length(v["whole"]), 1 - v["p"]), "0"), down))

    def rounded(v: Column) -> Column:
        digits = F.regexp_replace(F.concat(F.lit("0"), v["d"]), r"^0+(?=\d)", "")
        text = let(digits, lambda x: F.when(v["after"] >= "5", _plus_one(x)).otherwise(x))
        return let(text, lambda x: F.when(x == "0", x).otherwise(F.concat(v["sign"], x)))

    return F.when(number.isNotNull() & power.isNotNull(), let(let(parts, shifted), rounded))


def _plus_one(digits: Column) -> Column:
    def add(v: Column) -> Column:
        head = F.substring(v["d"], F.lit(1), F.length(v["d"]) - v["nines"])
        last = let(
            head,
            lambda h: F.when(h == "", "1").otherwise(
                F.concat(F.substring(h, F.lit(1), F.length(h) - 1), (F.right(h, F.lit(1)).cast("int") + 1).cast("string"))
            )
        )
        return F.concat(last, F.repeat(F.lit("0"), v["nines"]))

    return let(F.struct(digits.alias("d"), F.length(F.regexp_extract(digits, r"(9*)$", 1)).alias("nines")), add)


def hex_text(digits: Column) -> Column:
    """Hexadecimal digits of any number (no prefix) as decimal text.

    Up to 16 digits fit a machine word.  Of longer ones, eight digits at a time are folded into limbs of
    nine decimal digits, so words of any size stay exact.
    """

    def text(d: Column) -> Column:
        return F.when(d == "", F.lit(None)).when(F.length(d) <= 16, F.conv(d, 16, 10)).otherwise(_long_hex_text(d))

    return let(F.regexp_replace(digits, r"^0+(?=[0-9a-fA-F])", ""), text)


def _long_hex_text(digits: Column) -> Column:
    n = F.ceil(F.length(digits) / 8.0).cast("int")
    padded = F.lpad(digits, n * 8, "0")
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.conv(F.substring(padded, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    base = F.lit(1_000_000_000).cast("long")
    start = F.array_repeat(F.lit(0).cast("long"), (n * 1.08).cast("int") + 1)  # 9.64 decimal digits to eight

    def fold(limbs: Column, word: Column) -> Column:
        def step(acc: Column, limb: Column) -> Column:
            full = limb * F.lit(1 << 32).cast("long") + acc["carry"]
            return F.struct(F.call_function("div", full, base).alias("carry"), F.concat(acc["out"], F.array(full % base)).alias("out"))

        return F.aggregate(limbs, F.struct(word.alias("carry"), F.array().cast("array<bigint>").alias("out")), step)["out"]

    limbs = F.aggregate(words, start, fold)
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.regexp_replace(text, r"^0+(?=\d)", "")


@dataclass(frozen=True)
class Mixture:
    """Log-scale mixture: component ``k`` is normal around ``centre - powers[k]`` with a common width."""

    powers: tuple[int, ...]
    weights: tuple[float, ...]
    centre: float
    width: float

    @classmethod
    def fit(
        cls,
        histogram: Sequence[tuple[float, int]],
        powers: Sequence[int],
        centre: float,
        width: float = 0.3,
        rounds: int = 60,
        least_width: float = 0.02
    ) -> Mixture:
        """EM from ``(log10 value, rows)``; an empty histogram gives equal weights."""
        x = np.array([h[0] for h in histogram], dtype=float)
        n = np.array([h[1] for h in histogram], dtype=float)
        p = np.array(powers, dtype=float)
        w = np.full(len(p), 1 / len(p))
        for _ in range(rounds if len(x) else 0):
            z = (x[:, None] - (centre - p)) / width
            log = np.log(w) - 0.5 * z * z
            r = np.exp(log - log.max(axis=1, keepdims=True))
            r *= (n / r.sum(axis=1))[:, None]
            w = (r.sum(axis=0) + 1e-6) / (n.sum() + 1e-6 * len(p))
            centre = float((r * (x[:, None] + p)).sum() / n.sum())
            width = max(least_width, math.sqrt(float((r * (x[:, None] + p - centre) ** 2).sum() / n.sum())))
        return cls(tuple(powers), tuple(w.tolist()), centre, width)

    def posterior(self, x: Column, agrees: Callable[[int], Column] | None = None) -> Column:
        """``struct(power, probability, sure)`` of the most probable unit for a log10 value.

        ``agrees(power)`` is other evidence for a unit in the row; with it a flat component stands for rows
        that no unit explains, and the power is null where that is the most probable.
        """
        scale = math.log(self.width * math.sqrt(2 * math.pi))

        def logs(v: Column) -> Column:
            z = lambda p: (v - F.lit(self.centre - p)) / F.lit(self.width)
            told = lambda p: F.when(agrees(p), math.log(1 - AGAINST)).otherwise(math.log(AGAINST)) if agrees else F.lit(0.0)
            units = [
                F.struct((F.lit(math.log(w) - scale) - z(p) * z(p) * 0.5 + told(p)).alias("v"), F.lit(p).alias("p"))
                for p, w in zip(self.powers, self.weights, strict=True)
            ]
            none = F.struct(F.lit(math.log(NO_UNIT / DECADES)).alias("v"), F.lit(None).cast("int").alias("p"))
            return F.array(*units, *([none] if agrees else []))

        def best(all_: Column) -> Column:
            total = lambda top: F.aggregate(all_, F.lit(0.0), lambda acc, y: acc + F.exp(y["v"] - top["v"]))
            probable = lambda top: F.struct(top["p"].alias("power"), (F.lit(1.0) / total(top)).alias("probability"))
            return let(let(F.array_max(all_), probable), lambda g: F.struct(
                g["power"].alias("power"), g["probability"].alias("probability"),
                (g["power"].isNotNull() & (g["probability"] >= SURE)).alias("sure"),
            ))

        return let(let(x, logs), best)


def other_contexts(rows: DataFrame, mentions: Column, known: Column, agrees: Callable[[int], Column], powers: Sequence[int]) -> list[int]:
    """Slots of the contexts in which unit names are about something else than the quantity, from all rows.

    In rows with evidence (``known``), a context about the quantity names a unit that agrees with it in
    ``NAMES_RIGHT`` of them; any other context agrees as often as that unit does over all rows.  A slot
    belongs to the others if that is the more probable, given ``ABOUT_IT``.  At most ``CONTEXT_SLOTS`` rows
    per power come to the driver.
    """
    fits = F.create_map(*(x for p in powers for x in (F.lit(p), F.coalesce(agrees(p), F.lit(False)))))
    known = rows.where(known).select(fits.alias("fits"), mentions.alias("m"))
    seen = known.select("fits", F.explode("m").alias("m")).select("m.*", F.try_element_at("fits", F.col("m.power")).alias("ok"))
    counts = seen.where(F.col("ok").isNotNull()).groupBy("slot", "power", "ok").count().collect()
    if not counts:
        return []
    chance = known.agg(F.count("*").alias("n"), *(F.count_if(F.col("fits")[p]).alias(f"f{k}") for k, p in enumerate(powers))).first()
    usual = {p: min(0.98, max(0.01, chance[f"f{k}"] / chance["n"])) for k, p in enumerate(powers)}
    odds: dict[int, float] = {}
    for r in counts:
        right, by_chance = (NAMES_RIGHT, usual[r["power"]]) if r["ok"] else (1 - NAMES_RIGHT, 1 - usual[r["power"]])
        odds[r["slot"]] = odds.get(r["slot"], math.log(ABOUT_IT / (1 - ABOUT_IT))) + r["count"] * math.log(right / by_chance)
    return sorted(s for s, x in odds.items() if x < 0)


def log_bin(x: Column) -> Column:
    """Log10 of a positive value in steps of 1/100; null otherwise."""
    return F.when(x > 0, F.round(F.log10(x.cast("double")), 2))


def fit_units(df: DataFrame, value: Column, powers: Sequence[int], centre: float, width: float = 0.3) -> Mixture:
    """Fits the mixture on all rows of ``df`` through a histogram of the log scale (some hundred bins)."""
    bins = df.select(log_bin(value).alias("x")).where(F.col("x").isNotNull()).groupBy("x").count().collect()
    return Mixture.fit(sorted((r["x"], r["count"]) for r in bins), powers, centre, width)
