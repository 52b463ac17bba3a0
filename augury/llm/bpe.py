"""Byte-level BPE of whole texts by batched numpy merge rounds.

The new words of a batch lie as bytes in one flat array of symbols.  Each round looks up all neighbour
pairs by binary search over the sorted pair keys, takes the lowest rank in each word, merges that pair
everywhere in the word (left to right) and compacts the array; words without a mergeable pair are done.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.batches import slices, words_in

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_MOST = 500_000
_NO = np.iinfo(np.int64).max


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file (a rule of the format)."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in keep:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(0x100 + k)
    return out


class ByteBpe:
    """The vocabulary as arrays: byte ids, and sorted pair keys with rank and merged id."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        self.bytes = np.array([vocab[c] for c in _byte_letters()], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; a very large number where the pair has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each (non-empty) word."""
        raw = [w.encode("utf-8", "replace") for w in words]
        symbols = self.bytes[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            ranks = np.full(len(symbols), _NO)
            near = word[:-1] == word[1:]
            ranks[:-1][near] = self.rank(symbols[:-1][near], symbols[1:][near])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.r_[starts, len(word)]))
            over = least == _NO
            done.append((word[over], symbols[over]))
            merge = (ranks == least) & ~over
            at = np.flatnonzero(merge)
            if len(at):  # overlapping pairs (aaa): every second one of a run, from its first
                run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
                head = np.repeat(at[run], np.diff(np.r_[run, len(at)]))
                at = at[(at - head) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            keep = ~over
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        owner = np.concatenate([d[0] for d in done])
        ids = np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(raw) + 1)).tolist()
        ids = ids[order].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def encode(
    docs: DataFrame,
    vocabulary: str = DEFAULT_VOCABULARY,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(<id>, <keep>..., ids)`` of every document; empty and null texts give the empty list.

    The vocabulary is read once on the driver and broadcast (its size is that of the file's 50,000
    merges).  Rows stay in place: there is no shuffle.  No special tokens are produced; their strings in
    a text are ordinary text.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(ByteBpe.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pattern, cache = model.value, regex.compile(PATTERN), {}

        def ids_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Ids of all words in a row, and where each word ends."""
            fresh = [w for w in set(words) if w not in cache]
            if len(cache) + len(fresh) > CACHE_MOST:
                cache.clear()
                fresh = list(set(words))
            if fresh:
                cache.update(zip(fresh, bpe.encode_words(fresh), strict=True))
            lists = list(map(cache.__getitem__, words))
            ends = np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
            return np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]) if len(ends) else 0), ends

        for batch in batches:
            texts = batch.column("__text").to_pylist()
            rest = batch.select([c for c in batch.schema.names if c != "__text"])
            for a, b in slices(texts):
                if b - a == 1:  # perhaps a very long text
                    parts = [ids_of(w)[0] for w in words_in(pattern, texts[a] or "")]
                    flat, sizes = np.concatenate([np.zeros(0, dtype=np.int32), *parts]), [sum(map(len, parts))]
                else:
                    words = [pattern.findall(t) if t else [] for t in texts[a:b]]
                    flat, ends = ids_of(list(chain.from_iterable(words)))
                    sizes = np.diff(np.r_[0, ends][np.cumsum([0, *map(len, words)])])
                offsets = pa.array(np.cumsum([0, *sizes]).astype(np.int32))  # of one slice
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, lists], names=[*rest.schema.names, "ids"])

    rows = docs.select(F.col(id_column), *(F.col(c) for c in keep), F.col(text_column).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)
