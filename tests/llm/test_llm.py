"""Text operators against a library, brute force and odd inputs."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from augury.llm import batches, bpe, canon, leakage
from augury.llm import queries as q

DOCS = "doc_id long, text string"
ODD = [
    "",
    None,
    " ",
    "\n\t",
    "a",
    "aaaaaaa",
    "hello world  \n\n x",
    "l'été ’s don't we'll",
    "日本語のテキスト",
    "мир и труд",
    "😬🚀 mixed ١٢٣",
    "<|endoftext|>",
    "\x00\x07 x",
    "é​",
    "x" * 5000,
    "ab" * 3000,
    " " * 300 + "y"
]


@pytest.fixture(scope="module")
def make(spark):
    return canon.Canon.of(spark)


@pytest.fixture(scope="module")
def stored(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def test_bpe_matches_library(spark, stored):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    rng = random.Random(0)
    noise = ["".join(rng.choice("abcdefgh etaoin.,'0123é\n日́") for _ in range(rng.randrange(400))) for _ in range(60)]
    texts = [x for _, x in stored] + ODD + noise
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert len(got) == len(texts)
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert all(got[k] == e.ids for k, e in enumerate(want))
    assert got[len(stored)] == [] and got[len(stored) + 1] == []
    assert bpe.encode(df.limit(0)).count() == 0
    kept = bpe.encode(df.withColumn("ids_", df.doc_id + 1), keep=["ids_"])
    assert kept.columns == ["doc_id", "ids_", "ids"] and all(r["ids_"] == r["doc_id"] + 1 and r["ids"] == got[r["doc_id"]] for r in kept.collect())


def test_bpe_round_trip():
    model = bpe.ByteBpe.load(bpe.DEFAULT_VOCABULARY)
    byte_of = {}
    letters = {c: b for b, c in enumerate(bpe._byte_letters())}
    import json

    with open(bpe.DEFAULT_VOCABULARY, encoding="utf-8") as f:
        byte_of = {
            i: bytes(letters[c] for c in token) for token, i in json.load(f)["model"]["vocab"].items() if all(c in letters for c in token)
        }
    words = ["aaaa", "aaa", "banana", "éé", "x" * 999]
    assert [b"".join(byte_of[i] for i in ids).decode() for ids in model.encode_words(words)] == words


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("thе", "the", True), ("Τhe", "The", True), ("ӏast", "last", True), ("ɑnԁ tօ", "and to", True), ("ＡＢＣ　１", "ABC 1", True), ("café", "café", True), (
            "ﬁle oﬃce", "file office", True
        ), ("a​b­⁠c﻿", "abc", True),
        (
            "x y z", "x y z", True
        ), ("Åre", "Åre", True), ("рост", "pост", True), ("Ωμεγα", "Ωμεγα", True), ("が", "が", True), ("Αθήνα", "Aθήνα", True),
        ("The", "the", False), ("cafe", "café", False), ("1", "l", False), ("0", "O", False), ("a b", "a  b", False), ("a\tb", "a b", False), (
            "a\r\nb", "a\nb", False
        ), ("a-b", "a–b", False), ("ё", "е", False), ("", "x", False),
    ],
)
def test_looks(make, a, b, same):
    assert (make(a) == make(b)) is same
    assert make(make(a)) == make(a)


def test_scripts_decide(make):
    """Script sets of the stored letters; without the choice of a script, confusable texts stay apart."""
    kinds = {
        "thе": ("mixed", "Latin"), "рынoк": ("mixed", "Cyrillic"), "аре": ("whole", "Latin"), "жук": ("single", "Cyrillic"), "市場は": ("single", None),
        "Bayの市場は": ("no script", None), "ѕсоре": ("whole", "Latin"), 
    }
    import unicodedata

    for token, want in kinds.items():
        kind, script = make.resolve(unicodedata.normalize("NFD", token))
        assert kind == want[0] and want[1] in (None, script), (token, kind, script)
    assert make.resolve(unicodedata.normalize("NFD", "Αθήνα"))[1] == "Greek"
    assert "Jpan" in make.scripts_of("市") & make.scripts_of("は") and make.scripts_of("1") is None
    plain = canon.Canon(make.widths, make.shapes, make.scripts, by_script=False)
    for a, b in (("thе", "the"), ("аре", "ape"), ("рынoк", "рынок")):
        assert make(a) == make(b) and plain(a) != plain(b)
    assert plain("ｔｈｅ") == make("ｔｈｅ") == "the"


def test_script_report(spark):
    texts = ["thе thе", "the", None, "", "аре", "рынoк жук"]
    got = {r["kind"]: (r["n_tokens"], r["n_docs"]) for r in canon.script_report(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {"mixed": (3, 2), "whole": (1, 1), "single": (1, 1)}
    assert canon.script_report(spark.createDataFrame([], DOCS)).count() == 0


def test_script_is_kept(make):
    assert make("Рынoк зaкрыт") == "Рынок закрыт" and make("Aθήνa") == "Αθήνα" and make("аpе") == "ape" and make("Bayの市場は") == "Bayの市場は"


def test_pairs_brute_force(spark, make, stored):
    extra = [
        (10_000 + k, t) for k, t in enumerate(
            ["thе end", "the end", "the end", "the  end", "the end", "", None, " ", " ", "​", "ｔhe end"] + ["copy"] * 200 + ["cорy"]
        )
    ]
    rows = stored + extra
    forms = defaultdict(list)
    for i, t in rows:
        if t and make(t).strip():
            forms[make(t)].append((i, t))
    want = {(min(a, b), max(a, b)) for group in forms.values() for a, x in group for b, y in group if a < b and x != y}
    df = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in canon.look_alike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    classes = {
        r["doc_id"]: (r["class_id"], r["n_docs"], r["n_spellings"], r["n_links"]) for r in canon.look_alike_classes(df).collect()
    }
    assert classes == {
        i: (min(j for j, _ in g), len(g), len({t for _, t in g}), sum(x != t for _, x in g)) for g in forms.values() for i, t in g
    }
    assert canon.look_alike_pairs(df.limit(0)).count() == 0
    texts = {r["doc_id"]: r["form"] for r in canon.forms(df).collect()}
    assert texts == {i: None if t is None else make(t) for i, t in rows}


def brute(docs, items, make):
    grams = defaultdict(set)
    for i, t in items:
        w = leakage.words_of(t, make)
        for k in range(len(w) - leakage.WORDS + 1):
            grams[tuple(w[k : k + leakage.WORDS])].add(i)
    return {
        (d, i) for d, t in docs for w in [leakage.words_of(t, make)] for k in range(len(w) - leakage.WORDS + 1) for i in grams.get(
            tuple(w[k : k + leakage.WORDS]), ()
        )
    }


def test_leaks(spark, small, make, stored, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/eval_items.parquet").collect()]
    word = items[0][1].split()
    docs = stored + [
        (20_000, " / ".join(word[:10]).upper()),
        (20_001, " ".join(word[:9])),
        (20_002, " ".join([*word[:6], "odd", *word[6:12]])),
        (20_003, "filler " * 160_000 + " ".join(word[3:15]) + " filler" * 160_000),
        (20_004, " ".join(word[:12]).replace("o", "ο"))
    ]
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(
        [*items, (900, "too short"), (901, None), (902, "")], "item_id long, text string"
    )
    want = brute(docs, items, make)
    assert {
        (20_000, items[0][0]), (20_003, items[0][0]), (20_004, items[0][0])
    } <= want and not {(20_001, items[0][0]), (20_002, items[0][0])} & want
    runs = {(r["doc_id"], r["item_id"]): r["n_words"] for r in leakage.leaked_items(df, it).collect()}
    assert {k for k, n in runs.items() if n >= leakage.WORDS} == want and runs[20_003, items[0][0]] >= 12
    monkeypatch.setattr(leakage, "ITEM_WORDS_PER_BLOCK", 900)  # several blocks of items, two scans
    monkeypatch.setattr(leakage, "BLOCKS_PER_SCAN", 2)
    again = leakage.leaked_items(df, it).where("n_words >= 10").select("doc_id", "item_id").collect()
    assert len(again) == len(want) and set(map(tuple, again)) == want
    assert leakage.leaked_items(df.limit(0), it).count() == 0 and leakage.leaked_items(df, it.limit(0)).count() == 0


def index_of(items):
    """An index over ``(id, word hashes)`` with the rarity of their words."""
    counts = np.zeros(leakage.RARITY_SLOTS, dtype=np.int64)
    for _, w in items:
        np.add.at(counts, (np.unique(w) & np.uint64(leakage.RARITY_SLOTS - 1)).astype(np.int64), 1)
    return leakage.ItemIndex(items, leakage.Rarity(counts, len(items)))


@pytest.mark.parametrize("size", [10, 20, 28, 40])
def test_blocks_miss_nothing_within_radius(size):
    """Every pair of fingerprints within the radius is found, whichever bits differ."""
    rng = np.random.default_rng(1)
    index = next(x for x in index_of([(1, rng.integers(0, 1 << 63, 300).astype(np.uint64))]).sizes if x.size == size)
    assert index.radius == (leakage.RADIUS if size == 10 else leakage.WIDE_RADIUS)
    for _ in range(100):
        target = rng.integers(len(index.prints))
        bits = rng.choice(64, size=rng.integers(0, index.radius + 1), replace=False)
        probe = index.prints[target] ^ np.bitwise_or.reduce(np.r_[np.uint64(0), np.left_shift(np.uint64(1), bits.astype(np.uint64))])
        window, passage = index.near(np.array([probe], dtype=np.uint64))
        want = np.flatnonzero(np.bitwise_count(index.prints ^ probe) <= index.radius)
        assert set(passage.tolist()) == set(want.tolist()) and target in passage


def test_window_sums():
    """The sums of every size are those of its words, for texts of any length."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 9, 10, 13, 27, 90):
        bits = rng.integers(-8, 9, (n, 64)).astype(np.int16)
        for size, sums in leakage.window_sums(bits, 80):
            want = [bits[k : k + size].sum(axis=0) for k in range(n - size + 1)]
            assert len(sums) == len(want) and all((a == b).all() for a, b in zip(sums, want, strict=True))


def planted(items, rng):
    """``(kind, item, words)``: items with one or two words replaced anywhere, and thirds and halves of items, amid other words."""
    other = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for i, w in items:
        for edits in (1, 2):
            changed = w.copy()
            changed[rng.choice(len(w), edits, replace=False)] = other(edits)
            yield f"{edits} edits", i, np.concatenate([other(30), changed, other(30)])
        for part in (2, 3):
            n = max(leakage.WORDS, len(w) // part)
            at = rng.integers(0, len(w) - n + 1)
            yield f"1/{part}", i, np.concatenate([other(30), w[at : at + n], other(30)])


def test_recall_of_edited_and_partial_leaks(spark, small, make):
    """Against all pairs of windows and passages: at least 0.9 of the similar pairs, and every leak of ten equal words."""
    hasher = leakage.Hasher(make)
    items = [(r["item_id"], hasher(r["text"])) for r in spark.read.parquet(f"{small}/eval_items.parquet").collect()]
    items = [(i, w) for i, w in items if len(w) >= 20]
    index, rng = index_of(items), np.random.default_rng(3)
    by_size = {x.size: x for x in index.sizes}
    similar = hit = 0
    shares: dict[str, list[bool]] = {}
    for kind, i, words in planted(items, rng):
        found = index.search(words, np.zeros(len(words), dtype=np.int64))
        owner = index.ids[index.owner(found["start"].to_numpy(dtype=np.int64))] if len(found) else np.zeros(0)
        shares.setdefault(kind, []).append(bool((owner == i).any()))
        got = set(zip(found["size"], found["at"], found["start"], strict=True))
        weights, shingles = index.rarity(words), leakage._shingles(words)
        for size, x in by_size.items():
            starts = x.starts[index.ids[index.owner(x.starts)] == i]
            at = np.arange(len(words) - size + 1)
            window, start = np.repeat(at, len(starts)), np.tile(starts, len(at))
            near = (words[window[:, None] + np.arange(size)] == index.hashes[start[:, None] + np.arange(size)]).sum(axis=1) >= size // 2
            window, start = window[near], start[near]
            if len(window):
                ok = index.verify(size, shingles, weights, window, start) >= leakage.SIMILAR
                similar += ok.sum()
                hit += sum((size, a, b) in got for a, b in zip(window[ok], start[ok], strict=True))
    recall = {k: sum(v) / len(v) for k, v in shares.items()}
    print(f"windows {hit / similar:.3f} of {similar}, leaks {recall}")
    assert similar > 1000 and hit / similar >= 0.9
    assert all(r >= 0.9 for r in recall.values()) and recall["1/2"] == recall["1/3"] == 1


def test_slices_and_words():
    texts = ["a" * n for n in (3, 0, 4, 20, 1, 1)] + [None]
    for most in (1, 5, 8, 1000):
        cut = list(batches.slices(texts, most))
        assert [k for a, b in cut for k in range(a, b)] == list(range(7))
        assert all(b - a == 1 or sum(len(t or "") for t in texts[a:b]) <= most for a, b in cut)
    assert list(batches.slices([])) == []
    long = "ab cd " * 400_000
    parts = list(batches.words_in(leakage._WORD, long, 1000))
    assert len(parts) == 800 and sum(parts, []) == leakage._WORD.findall(long)


def test_very_long_text(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    long = "".join(f"word{k % 977} é{k % 13}, " for k in range(200_000))
    got = bpe.encode(spark.createDataFrame([(1, long), (2, "x"), (3, None)], DOCS)).collect()
    assert {r["doc_id"]: len(r["ids"]) for r in got} == {1: len(t.encode(long).ids), 2: 1, 3: 0}


def test_queries_run(spark, small):
    from augury.llm.registry import queries

    for name, query in queries().items():
        df = query(spark, small)
        assert df.count() >= 0, name
    assert q.p8_found(spark, small).columns == [
        "doc_id", "item_id"
    ] and q.p9_found(spark, small).columns == ["doc_a", "doc_b"] and q.p7_ids(spark, small).columns == ["doc_id", "ids"]
