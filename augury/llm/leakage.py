"""Evaluation texts inside training texts: SimHash windows, multi-index blocks, shingle check.

Windows slide over every whole document in the sizes of a ladder (10, 20, 28, 40, 56, ... words, each about
1.4 times the last).  An item is searched by windows of the largest size it fills and, for partial leaks, by
those of all smaller sizes: at 10 words, the smallest leak that counts, every passage of the item, above
it passages at every half window and at the end.  Each window has a 64-bit SimHash of its words, weighted
by how rare a word is among all items.

The fingerprints of the passages of one size are indexed by four 16-bit blocks.  Two fingerprints within
the radius differ in at most a fourth of it in some block, so a passage is entered under all keys that far
away and no pair within the radius is missed.  Candidates are verified by the weighted Jaccard similarity
of their five-word shingles; the longest run of equal words on the diagonal of each is the last, exact step.

The items are the query set.  They are read in blocks of bounded size, of which several are broadcast and
run in one scan of all documents.  Documents never move, and there is no join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import cached_property
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.batches import SLICE_CHARS, slices, words_in
from augury.llm.canon import Canon, _Chunks

WORDS = 10
LONGEST = 1280
SHINGLE = 5
SIMILAR = 0.8
#: Radius at the smallest size, where only equal windows reach ``SIMILAR``, and above (recall: see the tests).
RADIUS, WIDE_RADIUS = 3, 11
BLOCKS = 4
RARITY_SLOTS = 1 << 16
ITEM_WORDS_PER_BLOCK = 100_000
BLOCKS_PER_SCAN = 8
CHUNK_WORDS = 1 << 15
HITS_AT_ONCE = 2048
_WORD = re.compile(r"[^\W_]+")
_MATCH = "doc_id long, item_id long, n_words int, doc_at int, item_at int, size int, similarity double"


def words_of(text: str | None, canon: Canon) -> list[str]:
    """The longest runs of letters and digits of the consistent form, in lower case."""
    return _WORD.findall(canon(text).lower()) if text else []


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Hasher:
    """Word hashes of whole texts; pieces between blanks are looked up, so a repeated piece is read once."""

    def __init__(self, canon: Canon):
        self.canon, words = canon, _Chunks(word_hash)
        self.pieces = _Chunks(lambda piece: tuple(map(words.__getitem__, _WORD.findall(canon.chunk(piece).lower()))))

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint64)
        if len(text) > SLICE_CHARS:
            return np.concatenate([np.zeros(0, dtype=np.uint64), *map(self._look_up, words_in(_PIECE, text))])
        return self._look_up(text.split(" "))

    def _look_up(self, pieces: list[str]) -> np.ndarray:
        return np.array(list(chain.from_iterable(map(self.pieces.__getitem__, pieces))), dtype=np.uint64)


_PIECE = re.compile("[^ ]+")


def ladder(longest: int) -> list[int]:
    """Window sizes up to ``longest`` words: 10, 20, 28, 40, 56, 80, ..."""
    sizes = [WORDS] + [k * (1 << n) for n in range(1, 8) for k in (WORDS, WORDS + 4)]
    return [s for s in sizes if s <= min(longest, LONGEST)]


def window_sums(bits: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(size, sums)`` of the weighted bits of every window, size by size; each comes from two smaller ones."""

    def add(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        n = max(0, len(b) - shift)
        return a[:n] + b[shift : shift + n]

    two = add(bits, bits, 1)
    four = add(two, two, 2)
    main = add(add(four, four, 4), two, 8)
    side = add(main, four, 10)
    for size in ladder(longest):
        if size == WORDS:
            yield size, main
        elif size % 20 == 0 and size // 10 & (size // 10 - 1) == 0:
            main = add(main, main, size // 2)
            yield size, main
        else:
            side = add(side, side, size // 2)
            yield size, side


def sign_bits(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int16)
    return (2 * bits - 1) * weights.astype(np.int16)[:, None]


def simhashes(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """64-bit hash of the shingle that starts at each word; the last ``SHINGLE - 1`` words start none."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(hashes) - SHINGLE + 1), dtype=np.uint64)
        for k in range(SHINGLE):
            out = (out ^ hashes[k : len(hashes) - SHINGLE + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def longest_runs(same: np.ndarray) -> np.ndarray:
    """The longest run of true cells in each row."""
    best = run = np.zeros(len(same), dtype=np.int32)
    for k in range(same.shape[1]):
        run = (run + 1) * same[:, k]
        best = np.maximum(best, run)
    return best


class Rarity:
    """Weights of words by how few items hold them; counts per hash slot, of fixed size whatever the items."""

    def __init__(self, counts: np.ndarray, n_items: int):
        self.weight = (1 + np.log2((1 + n_items) / (1 + np.minimum(counts, n_items)))).astype(np.int16)

    @classmethod
    def of(cls, words: DataFrame) -> Rarity:
        """From one pass over the hashed words of all items (at most ``RARITY_SLOTS`` rows come to the driver)."""
        slots = words.select(F.explode(F.array_distinct("words")).alias("h")).groupBy(F.expr(f"h & {RARITY_SLOTS - 1}").alias("slot")).count()
        counts = np.zeros(RARITY_SLOTS, dtype=np.int64)
        for r in slots.collect():
            counts[r["slot"]] = r["count"]
        return cls(counts, words.count())

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.weight[(hashes & np.uint64(RARITY_SLOTS - 1)).astype(np.int64)]


class SizeIndex:
    """Passages of one size, entered under every key within a fourth of the radius in each 16-bit block."""

    def __init__(self, size: int, starts: np.ndarray, prints: np.ndarray):
        self.size, self.starts, self.prints = size, starts, prints
        self.radius = RADIUS if size == WORDS else WIDE_RADIUS
        flips = [0]
        for n in range(1, self.radius // BLOCKS + 1):
            flips += [sum(1 << b for b in bits) for bits in combinations(range(16), n)]
        self.tables = []
        for k in range(BLOCKS):
            key = (self.block(prints, k)[:, None] ^ np.array(flips)).ravel()
            order = np.argsort(key, kind="stable")
            ends = np.searchsorted(key[order], np.arange((1 << 16) + 1)).astype(np.int32)
            self.tables.append((ends[:-1], np.diff(ends), (order // len(flips)).astype(np.int32)))

    @staticmethod
    def block(prints: np.ndarray, k: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(window, passage)`` of all pairs within the radius, each once."""
        found = [np.zeros(0, dtype=np.int64)]
        for k, (starts, counts, passages) in enumerate(self.tables):
            key = self.block(prints, k)
            n = counts[key]
            has = np.flatnonzero(n)
            n = n[has]
            ends = np.cumsum(n)
            window = np.repeat(has, n)
            passage = passages[np.arange(len(window)) + np.repeat(starts[key[has]] - ends + n, n)]
            near = np.flatnonzero(np.bitwise_count(prints[window] ^ self.prints[passage]) <= self.radius)
            found.append(window[near] * len(self.prints) + passage[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


class ItemIndex:
    """A block of items as ``(id, word hashes)``; its indexes are built where they are used."""

    def __init__(self, items: Sequence[tuple[int, np.ndarray]], rarity: Rarity):
        self.rarity = rarity
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.lengths = np.array([len(w) for _, w in items], dtype=np.int64)
        self.hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(w for _, w in items)])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("rarity", "ids", "lengths", "hashes")}

    @cached_property
    def first(self) -> np.ndarray:
        """Where each item begins among the words of the block."""
        return np.r_[0, np.cumsum(self.lengths)]

    @cached_property
    def weights(self) -> np.ndarray:
        return self.rarity(self.hashes)

    @cached_property
    def shingles(self) -> np.ndarray:
        return _shingles(self.hashes)

    @cached_property
    def sizes(self) -> list[SizeIndex]:
        if not len(self.hashes):
            return []
        out = []
        for size, sums in window_sums(sign_bits(self.hashes, self.weights), int(self.lengths.max())):
            step = 1 if size == WORDS else size // 2
            places = [
                a + np.unique(np.r_[np.arange(0, n - size + 1, step), n - size])
                for a, n in zip(self.first, self.lengths, strict=False) if n >= size
            ]
            if places:
                at = np.concatenate(places)
                out.append(SizeIndex(size, at, simhashes(sums[at])))
        return out

    def owner(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, starts, side="right") - 1

    def verify(
        self, size: int, shingles: np.ndarray, weights: np.ndarray, window: np.ndarray, start: np.ndarray
    ) -> np.ndarray:
        """Weighted Jaccard similarity of the shingles of windows and passages."""
        span = np.arange(size - SHINGLE + 1)
        cum = lambda w: np.r_[0, np.cumsum(w, dtype=np.int64)]
        mine_c, theirs_c = cum(weights), cum(self.weights)
        out = np.zeros(len(window))
        for a in range(0, len(window), HITS_AT_ONCE):
            x, y = window[a : a + HITS_AT_ONCE, None] + span, start[a : a + HITS_AT_ONCE, None] + span
            mine, theirs = shingles[x], self.shingles[y]
            mine_w, theirs_w = mine_c[x + SHINGLE] - mine_c[x], theirs_c[y + SHINGLE] - theirs_c[y]
            common = np.zeros(len(x), dtype=np.int64)
            for k in range(len(span)):
                common += mine_w[:, k] * (mine[:, k, None] == theirs).any(axis=1)
            out[a : a + HITS_AT_ONCE] = common / np.maximum(1, mine_w.sum(axis=1) + theirs_w.sum(axis=1) - common)
        return out

    def search(self, hashes: np.ndarray, owner: np.ndarray) -> pd.DataFrame:
        """Verified windows over the words of some documents; ``owner`` rises and names the document of each word."""
        found = []
        longest = max((x.size for x in self.sizes), default=0)
        by_size = {x.size: x for x in self.sizes}
        for a in range(0, len(hashes) - WORDS + 1, CHUNK_WORDS) if longest else ():
            part = hashes[a : a + CHUNK_WORDS + longest - 1]
            whose = owner[a : a + len(part)]
            weights = self.rarity(part)
            shingles = None
            for size, sums in window_sums(sign_bits(part, weights), longest):
                if size not in by_size:
                    continue
                n = min(CHUNK_WORDS, len(sums))
                inside = np.flatnonzero(whose[:n] == whose[size - 1 : size - 1 + n])
                index = by_size[size]
                window, passage = index.near(simhashes(sums[:n])[inside])
                if not len(window):
                    continue
                window, start = inside[window], index.starts[passage]
                shingles = _shingles(part) if shingles is None else shingles
                likeness = self.verify(size, shingles, weights, window, start)
                ok = likeness >= SIMILAR
                window, start, likeness = window[ok], start[ok], likeness[ok]
                span = np.arange(size)
                runs = longest_runs(part[window[:, None] + span] == self.hashes[start[:, None] + span])
                found.append(pd.DataFrame({"at": window + a, "start": start, "similarity": likeness, "run": runs, "size": size}))
        if not found:
            return pd.DataFrame({"at": [], "start": [], "similarity": [], "run": [], "size": []})
        return pd.concat(found, ignore_index=True)


def _search(ids: Sequence[int], texts: Sequence[str | None], hasher: Hasher, index: ItemIndex) -> pd.DataFrame | None:
    """Leaked passages of some documents: equal windows joined to runs along each diagonal, similar ones at their best place."""
    parts = [hasher(t) for t in texts]
    lengths = [len(p) for p in parts]
    first = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    hits = index.search(np.concatenate([np.zeros(0, dtype=np.uint64), *parts]), np.repeat(np.arange(len(ids)), lengths))
    if not len(hits):
        return None
    hits = hits.astype({"at": np.int64, "start": np.int64, "size": np.int64, "run": np.int64})
    doc, item = np.searchsorted(first, hits["at"].to_numpy(), side="right") - 1, index.owner(hits["start"].to_numpy())
    hits["doc"], hits["item"] = doc, item
    hits["doc_at"], hits["item_at"] = hits["at"] - first[doc], hits["start"] - index.first[item]
    equal = hits[hits["run"] == hits["size"]].copy()
    equal["diagonal"] = equal["doc_at"] - equal["item_at"]
    equal = equal.sort_values(["doc", "item", "size", "diagonal", "doc_at"], kind="stable", ignore_index=True)
    joined = equal[equal["size"] == WORDS]
    step = (joined[["doc", "item", "diagonal"]].diff().fillna(1) != 0).any(axis=1) | (joined["doc_at"].diff() != 1)
    runs = joined.groupby(step.cumsum()).agg(
        doc=("doc", "first"), item=("item", "first"), doc_at=("doc_at", "first"), item_at=("item_at", "first"),
        size=("size", "first"), similarity=("similarity", "max"), run=("doc_at", "size")
    )
    runs["run"] += WORDS - 1
    wide = hits[(hits["size"] > WORDS) | (hits["run"] < hits["size"])].sort_values(
        ["doc", "item", "size", "item_at", "similarity", "doc_at"], ascending=[True, True, True, True, False, True], kind="stable"
    ).drop_duplicates(["doc", "item", "size", "item_at"])
    names = ["doc", "item", "run", "doc_at", "item_at", "size", "similarity"]
    out = pd.concat([runs[names], wide[names]], ignore_index=True)
    return pd.DataFrame(
        {
            "doc_id": np.array(ids, dtype=np.int64)[out["doc"].to_numpy(dtype=np.int64)],
            "item_id": index.ids[out["item"].to_numpy(dtype=np.int64)],
            "n_words": out["run"].astype(np.int32),
            "doc_at": out["doc_at"].astype(np.int32),
            "item_at": out["item_at"].astype(np.int32), "size": out["size"].astype(np.int32), "similarity": out["similarity"],
        }
    )


def hashed_words(items: DataFrame, canon) -> DataFrame:
    """``(item_id, words)``: word hashes of each item with an id and at least ``WORDS`` words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(canon.value)
        for pdf in frames:
            words = [hasher(t).view(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"item_id": pdf["item_id"], "words": words})

    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    return named.mapInPandas(run, "item_id long, words array<bigint>").where(F.size("words") >= WORDS)


def _item_blocks(words: DataFrame) -> Iterator[ItemIndex]:
    """Indexes over blocks of at most so many words (one item may go beyond); one table of rarity for all."""
    rarity = Rarity.of(words)
    block, size = [], 0
    for row in words.toLocalIterator():
        hashes = np.array(row["words"], dtype=np.int64).view(np.uint64)
        block.append((row["item_id"], hashes))
        size += len(hashes)
        if size >= ITEM_WORDS_PER_BLOCK:
            yield ItemIndex(block, rarity)
            block, size = [], 0
    if block:
        yield ItemIndex(block, rarity)


def find_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_words, doc_at, item_at, size, similarity)``: leaked passages.

    A row is a run of at least 10 equal words (``size`` 10, ``n_words`` its length) or a window of
    ``size`` words with a similarity of 0.8 or more (``n_words``: its longest run of equal words).
    Positions count words from 0.  Null and empty texts hold nothing; items below 10 words have no
    passage; rows without an id can't be reported and are left out.
    """
    spark = docs.sparkSession
    canon = spark.sparkContext.broadcast(Canon.of(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    blocks = [spark.sparkContext.broadcast(b) for b in _item_blocks(hashed_words(items, canon))]
    out = None
    for k in range(0, len(blocks), BLOCKS_PER_SCAN):
        shared = blocks[k : k + BLOCKS_PER_SCAN]

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            hasher = Hasher(canon.value)
            for pdf in frames:
                ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
                for a, b in slices(texts):
                    for index in shared:
                        found = _search(ids[a:b], texts[a:b], hasher, index.value)
                        if found is not None:
                            yield found

        found = rows.mapInPandas(run, _MATCH)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _MATCH) if out is None else out


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_words, n_passages, size, similarity)``: one row per document and item it holds.

    ``n_words`` is the longest run of equal words; ``size`` the largest window that is similar, with its
    best ``similarity``.
    """
    best = F.max(F.struct("size", F.round("similarity", 6).alias("similarity"))).alias("best")
    runs = find_passages(docs, items).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.count("*").alias("n_passages"), best)
    return runs.select("doc_id", "item_id", "n_words", "n_passages", "best.size", "best.similarity")
