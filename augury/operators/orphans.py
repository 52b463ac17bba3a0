"""Orphan references: child keys whose parent is missing, deleted or late, per table and month.

Child references are first reduced to one row per key and month with the first and last time seen
(map-side, so a hot key is one row per task).  Keys are then cut into ranges by hash.  Within a range
keys are dictionary-encoded as integers, and compressed bitmaps over these integers are built: per
month the keys referenced, and per month the keys that certainly live (parent first seen in an earlier
month, AND-NOT removed up to and with this month).  ``referenced AND-NOT live`` leaves a few bits, which
are decoded and settled by exact times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
ARRAY_MOST = 4096
_NONE = np.iinfo(np.int64).max


class KeyBitmap:
    """A compressed set of non-negative ints: per 65,536 values a sorted array, or a bitmap if dense."""

    __slots__ = ("chunks",)

    def __init__(self, chunks: dict[int, np.ndarray] | None = None):
        self.chunks = chunks or {}

    @classmethod
    def of(cls, values: np.ndarray) -> KeyBitmap:
        values = np.unique(values)
        high = values // CHUNK
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] // CHUNK): cls._pack((part % CHUNK).astype(np.uint16)) for part in np.split(values, cuts) if len(part)})

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= ARRAY_MOST:
            return low
        bits = np.zeros(CHUNK, dtype=bool)
        bits[low] = True
        return np.packbits(bits)

    @staticmethod
    def _bits(chunk: np.ndarray) -> np.ndarray:
        if chunk.dtype == np.uint8:
            return chunk
        bits = np.zeros(CHUNK, dtype=bool)
        bits[chunk] = True
        return np.packbits(bits)

    @staticmethod
    def _low(chunk: np.ndarray) -> np.ndarray:
        return chunk if chunk.dtype == np.uint16 else np.flatnonzero(np.unpackbits(chunk)).astype(np.uint16)

    def and_not(self, other: KeyBitmap) -> KeyBitmap:
        out = {}
        for at, mine in self.chunks.items():
            theirs = other.chunks.get(at)
            if theirs is None:
                out[at] = mine
                continue
            if mine.dtype == np.uint16:
                held = np.unpackbits(self._bits(theirs))[mine] if theirs.dtype == np.uint8 else np.isin(mine, theirs, assume_unique=True)
                rest = mine[~held.astype(bool)]
            else:
                rest = self._low(mine & ~self._bits(theirs))
            if len(rest):
                out[at] = self._pack(rest)
        return KeyBitmap(out)

    def decode(self) -> np.ndarray:
        parts = [self._low(self.chunks[at]).astype(np.int64) + at * CHUNK for at in sorted(self.chunks)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key range of one child table: encode, AND-NOT per month, decode, settle by exact times."""
    code, names = pd.factorize(pdf["ref_key"])
    role, month = pdf["role"].to_numpy(), pdf["month"].to_numpy()
    first, last = pdf["t_first"].to_numpy(), pdf["t_last"].to_numpy()
    born, gone = np.full(len(names), _NONE), np.full(len(names), _NONE)
    known = np.zeros(len(names), dtype=bool)
    born_month, gone_month = np.full(len(names), _NONE), np.full(len(names), _NONE)
    at = role == 1
    known[code[at]] = True
    timed = at & (first != _NONE)
    born[code[timed]], born_month[code[timed]] = first[timed], month[timed]
    at = (role == 2) & (first != _NONE)
    gone[code[at]], gone_month[code[at]] = first[at], month[at]
    out = []
    child = np.flatnonzero(role == 0)
    child = child[np.argsort(month[child], kind="stable")]
    for rows in np.split(child, np.flatnonzero(np.diff(month[child])) + 1):
        if not len(rows):
            continue
        m = month[rows[0]]
        referenced = KeyBitmap.of(code[rows])
        if m < 0:  # time unknown: only a missing parent can be told
            live = KeyBitmap.of(np.flatnonzero(known))
        else:
            live = KeyBitmap.of(np.flatnonzero(born_month < m)).and_not(KeyBitmap.of(np.flatnonzero(gone_month <= m)))
        doubt = referenced.and_not(live).decode()
        where = np.full(len(names), -1, dtype=np.int64)
        where[code[rows]] = rows
        row = where[doubt]
        lo, hi = first[row], last[row]
        missing = ~known[doubt]
        deleted = ~missing & (lo != _NONE) & (gone[doubt] <= hi)
        late = ~missing & (lo != _NONE) & (born[doubt] != _NONE) & (lo < born[doubt]) & (lo < gone[doubt])
        for kind, mask in (("missing", missing), ("deleted", deleted), ("late", late)):
            if mask.any():
                out.append(pd.DataFrame({"src": pdf["src"].iloc[0], "month": m, "ref_key": names[doubt[mask]], "kind": kind}))
    if not out:
        return pd.DataFrame(
            {"src": pd.Series(dtype=str), "month": pd.Series(dtype="int64"), "ref_key": pd.Series(dtype=str), "kind": pd.Series(dtype=str)}
        )
    return pd.concat(out, ignore_index=True)


def orphan_references(children: DataFrame, parents: DataFrame, removals: DataFrame, keys_per_range: int = 50_000) -> DataFrame:
    """Distinct ``(src, ref_month, ref_key, kind)`` of references that find no living parent.

    All three inputs have ``(src, ref_key, at)``: the child table's name, the canonical key and the time
    of the reference, the parent row or the removal.  ``kind`` is the first that holds: ``missing`` (no
    parent row at any time), ``deleted`` (removed at or before the reference), ``late`` (the earliest
    parent row is after the reference).  Null keys refer to nothing.  A reference without a time can only
    be missing and has a null month; parents without a time exist but are never late.
    """
    def micros(c):  # from the fields of the time, so the session's time zone plays no part
        seconds = F.unix_date(F.to_date(c)).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECONDS"), c) * 1_000_000).cast("long")

    month = lambda c: F.year(c) * 12 + F.month(c) - 1
    never = F.lit(_NONE).cast("long")

    def reduced(df: DataFrame, role: int, by_month: bool) -> DataFrame:
        df = df.where(F.col("ref_key").isNotNull())
        if by_month:
            df = df.withColumn("month", F.coalesce(month(F.col("at")), F.lit(-1)))
        df = df.groupBy("src", "ref_key", *(["month"] if by_month else [])).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
        if not by_month:
            df = df.withColumn("month", F.coalesce(month(F.col("lo")), F.lit(-1)))
        return df.select(
            "src", "ref_key", F.lit(role).cast("tinyint").alias("role"), F.col("month").cast("int"),
            F.coalesce(micros(F.col("lo")), never).alias("t_first"), F.coalesce(micros(F.col("hi")), never).alias("t_last"),
        )

    keys = children.select("src", "ref_key").unionByName(parents.select("src", "ref_key")).agg(
        F.approx_count_distinct(F.xxhash64("src", "ref_key"), 0.05)
    ).first()[0]
    ranges = max(1, -(-keys // keys_per_range))
    parts = reduced(children, 0, True).unionByName(reduced(parents, 1, False)).unionByName(reduced(removals, 2, False))
    parts = parts.withColumn("key_range", F.pmod(F.xxhash64("ref_key"), F.lit(ranges)).cast("int"))
    found = parts.groupBy("src", "key_range").applyInPandas(_settle, "src string, month long, ref_key string, kind string")
    text = F.format_string("%04d-%02d", F.expr("month div 12"), F.expr("month % 12 + 1"))
    return found.select("src", F.when(F.col("month") >= 0, text).alias("ref_month"), "ref_key", "kind")
