"""Cutting work on texts into pieces of bounded size, whatever the size of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice
from typing import Any

SLICE_CHARS = 2_000_000
SLICE_WORDS = 200_000


def slices(texts: Sequence[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with at most ``most`` characters together; a longer text stands alone."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > start and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def words_in(pattern: re.Pattern[str] | Any, text: str, most: int = SLICE_WORDS) -> Iterator[list[str]]:
    """All matches of ``pattern`` in lists of at most ``most``; short texts in one go."""
    if len(text) <= SLICE_CHARS:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while part := [m.group() for m in islice(found, most)]:
        yield part
