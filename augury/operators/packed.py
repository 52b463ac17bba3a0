"""Several values packed in one string: split into one row per value, position kept.

A field is read into atoms and separators; a quoted span is one atom whatever it holds.  Where the
separators leave more than one reading (``0,1`` is two values or one with a decimal comma), the readings
form a lattice.  Expectation-maximisation over the whole column learns how often values occur: counts of
hashed values and of value shapes, both of fixed size.  Viterbi decoding gives the best reading for each
number of values.  Fields of one row hold equally many values, and all rows of a record hold the same
values, so the number is settled by the row first and by the record's other rows next.

All texts are read once; what has a single reading is kept as lists in the shared folder, and only the
fields with several readings are looked at again.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.operators.lineage import cut

FIELDS = ("outcomes", "outcome_prices", "clob_token_ids")
DECIMAL_FIELDS = ("outcome_prices",)
# The separators, bracket pairs and letter escapes that occur in written lists.
SEPARATORS = ",;|~\t\n"
PAIRS = {"[": "]", "{": "}", "(": ")"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
BUCKETS = 1 << 14
SHAPES = ("empty", "whole", "point", "comma", "long", "word", "words", "mixed")
_CUT = re.compile(f"[{SEPARATORS}]")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}(?:\\u[dD][c-fC-F][0-9a-fA-F]{2})?|x[0-9a-fA-F]{2}|.)", re.S)
_DIGITS = re.compile(r"[+-]?\d+", re.A)

Atom = tuple[str, bool]
Reading = tuple[int, float, list[str]]


def _unescape(text: str) -> str:
    def one(m: re.Match[str]) -> str:
        e = m[1]
        if e[0] == "u" and len(e) > 1:
            units = [int(x, 16) for x in re.findall(r"u([0-9a-fA-F]{4})", e)]
            if len(units) == 2 and 0xD800 <= units[0] < 0xDC00:
                return chr(0x10000 + ((units[0] - 0xD800) << 10) + units[1] - 0xDC00)
            return "".join(map(chr, units)) if not any(0xD800 <= u < 0xE000 for u in units) else m[0]
        if e[0] == "x" and len(e) > 1:
            return chr(int(e[1:], 16))
        return ESCAPES.get(e, e)

    return _ESCAPE.sub(one, text) if "\\" in text else text


def _quoted(s: str, at: int) -> tuple[str, int] | None:
    """The content of the quoted span that opens at ``at`` and the place after it and its blanks."""
    q, j, n, doubled = s[at], at + 1, len(s), False
    while (j := s.find(q, j)) >= 0:
        back = j - 1
        while s[back] == "\\" and back > at:
            back -= 1
        if (j - 1 - back) % 2:
            j += 1
        elif s[j + 1 : j + 2] == q:
            doubled = True
            j += 2
        else:
            end = j + 1
            while end < n and s[end] in " \r":
                end += 1
            if end == n or s[end] in SEPARATORS:
                inner = s[at + 1 : j]
                return _unescape(inner.replace(q + q, q) if doubled else inner), end
            j += 1
    return None


def read_atoms(s: str) -> tuple[list[Atom], list[str]]:
    """Atoms ``(text, quoted)`` and the separators between them; brackets and outer encodings removed."""
    s = s.strip()
    if len(s) > 1 and PAIRS.get(s[0]) == s[-1]:
        s = s[1:-1].strip(" \r")
    elif len(s) > 3 and s[0] == '"' and (span := _quoted(s, 0)) and span[1] == len(s):
        inner = span[0].strip()
        if len(inner) > 1 and PAIRS.get(inner[0]) == inner[-1]:
            return read_atoms(inner)
    atoms: list[Atom] = []
    seps: list[str] = []
    at, n = 0, len(s)
    if not s:
        return atoms, seps
    while True:
        while at < n and s[at] in " \r":
            at += 1
        span = _quoted(s, at) if at < n and s[at] in "\"'" else None
        if span:
            atoms.append((span[0].strip(), True))
            at = span[1]
        else:
            m = _CUT.search(s, at)
            end = m.start() if m else n
            atoms.append((s[at:end].strip(), False))
            at = end
        if at >= n:
            break
        seps.append(s[at])
        at += 1
    if seps and atoms[-1] == ("", False):  # a separator at the very end adds no value
        atoms.pop()
        seps.pop()
    return atoms, seps


def shape(value: str) -> int:
    if not value:
        return 0
    if _DIGITS.fullmatch(value):
        return 1 if len(value) < 20 else 4
    for k, sep in ((2, "."), (3, ",")):
        left, found, right = value.partition(sep)
        if found and right.isdigit() and _DIGITS.fullmatch(left):
            return k
    return 7 if _CUT.search(value) else 6 if " " in value else 5


def bucket(value: str) -> int:
    return zlib.crc32(value.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class ValueModel:
    """How often values occur in one field: by hash bucket, and by shape for values not seen before."""

    values: np.ndarray
    shapes: np.ndarray

    @classmethod
    def flat(cls) -> ValueModel:
        return cls(np.zeros(BUCKETS), np.zeros(len(SHAPES)))

    def log(self, value: str) -> float:
        base = (self.shapes[shape(value)] + 0.1) / (self.shapes.sum() + 0.1 * len(SHAPES)) / BUCKETS
        return math.log((self.values[bucket(value)] + base * 64) / (self.values.sum() + 64))


def _decimal(atoms: list[Atom], seps: list[str], k: int) -> bool:
    """Whether the separator after atom ``k`` may be a decimal comma: between two bare digit runs."""
    (left, q1), (right, q2) = atoms[k], atoms[k + 1]
    return seps[k] == "," and not q1 and not q2 and right.isdigit() and bool(_DIGITS.fullmatch(left))


def _edges(atoms: list[Atom], seps: list[str], delimiter: str, decimals: bool) -> list[tuple[int, int, str]]:
    """Values that the lattice of one delimiter allows: ``(first atom, after last atom, text)``.

    A value of several atoms is two digit runs with a decimal comma; any other separator is quoted.
    """
    cuts = [0, *(k + 1 for k, x in enumerate(seps) if x == delimiter), len(atoms)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a == 1:
            out.append((a, b, atoms[a][0]))
        elif decimals and b - a == 2 and _decimal(atoms, seps, a):
            out.append((a, b, f"{atoms[a][0]},{atoms[a + 1][0]}"))
    if decimals and delimiter == ",":
        out += [(k, k + 2, f"{atoms[k][0]},{atoms[k + 1][0]}") for k in range(len(seps)) if _decimal(atoms, seps, k)]
    return out


def is_certain(atoms: list[Atom], seps: list[str], decimals: bool = True) -> bool:
    """Whether a field has one reading only; ``decimals``: whether its values may hold a decimal comma."""
    if len(set(seps)) > 1:
        return False
    if not seps or seps[0] != "," or not decimals:
        return True
    return not any(_decimal(atoms, seps, k) for k in range(len(seps)))


def readings(atoms: list[Atom], seps: list[str], model: ValueModel, decimals: bool = True) -> list[Reading]:
    """Viterbi: for each number of values the best reading ``(n, log probability, values)``.

    Mixed separators that allow no reading cut everywhere.
    """
    if is_certain(atoms, seps, decimals):
        return [(len(atoms), 0.0, [a for a, _ in atoms])]
    best: dict[int, Reading] = {}
    for d in dict.fromkeys(seps):
        at: list[dict[int, tuple[float, int, str]]] = [{} for _ in range(len(atoms) + 1)]
        at[0][0] = (0.0, -1, "")
        for a, b, text in sorted(_edges(atoms, seps, d, decimals)):
            w = model.log(text)
            for n, (score, _, _) in at[a].items():
                if score + w > at[b].get(n + 1, (-math.inf,))[0]:
                    at[b][n + 1] = (score + w, a, text)
        for n, (score, _, _) in at[-1].items():
            if score > best.get(n, (0, -math.inf))[1]:
                values, place = [], len(atoms)
                for left in range(n, 0, -1):
                    _, before, text = at[place][left]
                    values.append(text)
                    place = before
                best[n] = (n, score, values[::-1])
    return sorted(best.values(), key=lambda r: (-r[1], r[0])) or [(len(atoms), 0.0, [a for a, _ in atoms])]


def expected(atoms: list[Atom], seps: list[str], model: ValueModel, decimals: bool = True) -> list[tuple[str, float]]:
    """E-step: every value of the lattice with its posterior, by forward and backward sums."""
    if is_certain(atoms, seps, decimals):
        return [(a, 1.0) for a, _ in atoms]
    found, totals = [], []
    for d in dict.fromkeys(seps):
        edges = sorted(_edges(atoms, seps, d, decimals))
        weights = [model.log(t) for _, _, t in edges]
        ahead, back = [-math.inf] * (len(atoms) + 1), [-math.inf] * (len(atoms) + 1)
        ahead[0] = back[-1] = 0.0
        for (a, b, _), w in zip(edges, weights, strict=True):
            ahead[b] = float(np.logaddexp(ahead[b], ahead[a] + w))
        for (a, b, _), w in zip(reversed(edges), reversed(weights), strict=True):
            back[a] = float(np.logaddexp(back[a], back[b] + w))
        totals.append(ahead[-1])
        found += [(t, ahead[a] + w + back[b]) for (a, b, t), w in zip(edges, weights, strict=True)]
    total = float(np.logaddexp.reduce(totals))
    if total == -math.inf:
        return [(a, 1.0) for a, _ in atoms]
    return [(t, math.exp(x - total)) for t, x in found if x > -math.inf]


def _parse(s: str | None) -> tuple[list[Atom], list[str]] | None:
    """Atoms and separators, or None where the field holds no value."""
    if s is None or s.isspace() or not s:
        return None
    if s[0] == "[" and s[-1] == "]":
        try:
            values = json.loads(s, strict=False)
            if values and all(type(v) is str for v in values):
                return [(v.strip(), True) for v in values], [","] * (len(values) - 1)
        except ValueError:
            pass
    atoms, seps = read_atoms(s)
    return (atoms, seps) if atoms else None


def _slots(item: str) -> tuple[Column, Column]:
    """Where :func:`bucket` and :func:`shape` count an item, as columns."""
    i = F.col(item)
    number = lambda sep: i.rlike(rf"^[+-]?[0-9]+{sep}[0-9]+$")
    shapes = (
        F.when(i == "", 0)
        .when(i.rlike("^[+-]?[0-9]+$"), F.when(F.length(i) < 20, 1).otherwise(4))
        .when(number("[.]"), 2).when(number(","), 3)
        .when(i.rlike(f"[{SEPARATORS}]"), 7).when(i.contains(" "), 6).otherwise(5)
    )
    return (F.crc32(F.encode(i, "utf-8")) % BUCKETS).cast("int"), shapes + BUCKETS


def learn_values(lists: DataFrame, unsettled: DataFrame, fields: Sequence[str], decimals: Sequence[str], rounds: int = 2) -> dict[str, ValueModel]:
    """EM over each field: certain values count once, values of the lattices by their posterior in each later round.

    Every round sums over a fixed number of slots per field.
    """
    items = lists.select("field_name", F.explode("items").alias("item"))
    certain = items.select("field_name", F.explode(F.array(*_slots("item"))).alias("slot")).groupBy("field_name", "slot").agg(
        F.count("*").cast("double").alias("w")
    ).toPandas()
    base = {f: np.zeros(BUCKETS + len(SHAPES)) for f in fields}
    for f, slot, w in certain.itertuples(index=False, name=None):
        base[f][slot] += w
    models = {f: ValueModel(x[:BUCKETS], x[BUCKETS:]) for f, x in base.items()}
    for _ in range(1, rounds):
        now = models

        def counts(frames: Iterator[pd.DataFrame], now: dict = now) -> Iterator[pd.DataFrame]:
            sums = {f: np.zeros(BUCKETS + len(SHAPES)) for f in fields}
            for pdf in frames:
                for texts in pdf["raws"]:
                    for f, s in zip(fields, texts, strict=True):
                        if s is not None:
                            for value, w in expected(*_parse(s), now[f], f in decimals):
                                sums[f][bucket(value)] += w
                                sums[f][BUCKETS + shape(value)] += w
            for f, x in sums.items():
                slot = np.flatnonzero(x)
                yield pd.DataFrame({"f": f, "slot": slot.astype(np.int32), "w": x[slot]})

        got = unsettled.select("raws").mapInPandas(counts, "f string, slot int, w double").groupBy("f", "slot").agg(F.sum("w").alias("w")).toPandas()
        now = {f: x.copy() for f, x in base.items()}
        for f, slot, w in got.itertuples(index=False, name=None):
            now[f][slot] += w
        models = {f: ValueModel(x[:BUCKETS], x[BUCKETS:]) for f, x in now.items()}
    return models


def settle(parsed: dict[str, list[Reading]], row_n: int | None, record_n: int | None) -> dict[str, list[str]]:
    """One reading per field of a row: by the row's other fields, by the record's other rows, by probability.

    Where the fields share possible numbers of values, they take the same one, the most probable in
    total; a field that shares none takes its own best reading.
    """
    common = set.intersection(*({x[0] for x in r} for r in parsed.values()))
    for n in (row_n, record_n):
        if n in common:
            common = {n}
            break
    if common:
        best = max(common, key=lambda n: (sum(x[1] for r in parsed.values() for x in r if x[0] == n), -n))
        return {f: next(x[2] for x in r if x[0] == best) for f, r in parsed.items()}
    return {f: next((x[2] for n in (row_n, record_n) for x in r if x[0] == n), r[0][2]) for f, r in parsed.items()}


def split_packed(
    df: DataFrame, key: str, fields: Sequence[str] = FIELDS, decimals: Sequence[str] = DECIMAL_FIELDS, rounds: int = 2
) -> DataFrame:
    """Distinct ``(<key>, field_name, pos, item)`` over all rows; ``pos`` counts from 0.

    Null, empty and ``[]`` fields give no rows; a quoted empty value is a value; a separator at the very
    end adds none.  Items lose quotes, escapes and outer blanks and nothing else.  A null key is kept.
    Only values of the fields in ``decimals`` may hold a bare decimal comma.
    A reading that neither its row nor the record's other rows settle is the most probable one.
    """
    key_type = df.schema[key].dataType.simpleString()
    texts_schema = f"record {key_type}, field_name string, n int, items array<string>, raws array<string>"
    names = ["record", "field_name", "n", "items", "raws"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows: list[tuple] = []
            for record, *texts in pdf[[key, *fields]].itertuples(index=False, name=None):
                sizes, open_ = set(), [None] * len(fields)
                for k, (f, s) in enumerate(zip(fields, texts, strict=True)):
                    if (p := _parse(s)) is None:
                        continue
                    if is_certain(*p, f in decimals):
                        sizes.add(len(p[0]))
                        rows.append((record, f, len(p[0]), [a for a, _ in p[0]], None))
                    else:
                        open_[k] = s
                if any(s is not None for s in open_):
                    rows.append((record, None, sizes.pop() if len(sizes) == 1 else None, None, open_))
            yield pd.DataFrame(rows, columns=names).astype({"n": "Int32"})

    parts = cut(df.select(key, *fields).mapInPandas(read, texts_schema))
    lists, unsettled = parts.where(F.col("raws").isNull()), parts.where(F.col("raws").isNotNull())
    models = learn_values(lists, unsettled, fields, decimals, rounds)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if x is None or pd.isna(x) else int(x)
        for pdf in frames:
            rows = []
            for record, n, seen, raws in pdf[["record", "n", "seen", "raws"]].itertuples(index=False, name=None):
                open_ = {
                    f: readings(*_parse(s), models[f], f in decimals) for f, s in zip(fields, raws, strict=True) if s is not None
                }
                rows += [(record, f, v) for f, v in settle(open_, whole(n), whole(seen)).items()]
            yield pd.DataFrame(rows, columns=["record", "field_name", "items"])

    alone = unsettled.where(F.col("n").isNull()).drop("field_name", "items")
    seen = lists.join(alone.select("record").distinct(), "record", "left_semi").groupBy("record").agg(F.max("n").alias("seen"))
    asked = unsettled.where(F.col("n").isNotNull()).select("record", "n", F.lit(None).cast("int").alias("seen"), "raws").unionByName(
        alone.join(seen, "record", "left").select("record", "n", "seen", "raws")
    )
    decoded = asked.mapInPandas(decode, f"record {key_type}, field_name string, items array<string>")
    sets = lists.select("record", "field_name", "items").unionByName(decoded).groupBy("record", "field_name").agg(F.collect_set("items").alias("lists"))
    placed = F.transform("lists", lambda v: F.transform(v, lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("item"))))
    return sets.select(
        F.col("record").alias(key), "field_name", F.explode(F.array_distinct(F.flatten(placed))).alias("e")
    ).select(key, "field_name", "e.pos", "e.item")
