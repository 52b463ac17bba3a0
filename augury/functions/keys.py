"""Canonical forms of the join keys (tickers, ids, addresses, hashes).

A key is the same whatever its letter case and the blanks or tabs at its ends; blank keys are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def _trimmed(c: Column | str) -> Column:
    c = F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))
    return F.when(c != "", c)


def ticker_key(c: Column | str) -> Column:
    """Ticker in upper case without outer blanks; null where null or blank."""
    return F.upper(_trimmed(c))


def id_key(c: Column | str) -> Column:
    """Trade id or address in lower case without outer blanks; null where null or blank."""
    return F.lower(_trimmed(c))


def hash_key(c: Column | str) -> Column:
    """Transaction hash in lower case without outer blanks and without a leading 0x."""
    c = F.regexp_replace(id_key(c), "^0x", "")
    return F.when(c != "", c)


def fill_key(tx: Column | str, log_index: Column | str) -> Column:
    """``transaction_hash:log_index``; null where either part is."""
    log_index = F.col(log_index) if isinstance(log_index, str) else log_index
    return F.concat(hash_key(tx), F.lit(":"), log_index.cast("string"))
