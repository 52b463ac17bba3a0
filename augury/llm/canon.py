"""One consistent form for texts that look the same.

Steps per text: characters without width go, blanks become one blank, full-width and joined letters
become normal and separate ones, accents are split off.  Then each token is written in one script.  The
scripts of each stored letter (script extensions, with the combined writing systems of Japanese, Korean
and Chinese) are intersected to the token's resolved set, and the scripts that own a letter of the same
shape are intersected to the set of scripts that could write the whole token.  A token with an empty
resolved set mixes scripts; one that another script could write as well is a whole-script confusable.
The spelling selected is the Latin one if Latin could write the token, else that of the script that
could, and a token that no single script can write takes the Latin letter of every shape that has one.
The selected spelling is the form: nothing maps letters outside this choice.  Accents are joined again.

Since the second set depends on shapes alone, two tokens of one look get one spelling.  Letter case,
accents, digits, marks, line ends, tabs and the number of blanks stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augury.operators.lineage import cut
from augury.operators.skew import fragment_replicate_join, plan_loads

ASCII_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Control characters that are tabs or line ends; format characters that have a shape;
# ignorable marks and letters without width; symbols and letters drawn as a blank; a letter whose published twin (i) is not the one of its shape.
LINE_CONTROLS = "\t\n\v\f\r\x1c\x1d\x1e\x85"
VISIBLE_FORMATS = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
WIDTHLESS_MARKS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f"
BLANK_LETTERS = "\u2800\u3164\uffa0"
SHAPE_FIXES = {"\u04cf": "l"}
_CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x1f\x7f]")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_latin = regex.compile(r"\p{Script=Latin}")
LATIN = "Latin"
# Writing systems of several scripts, as script names of the security standard (UTS 39).
SYSTEMS = {
    "Han": ("Hanb", "Jpan", "Kore"), "Hiragana": ("Jpan",), "Katakana": ("Jpan",), "Hangul": ("Kore",), "Bopomofo": ("Hanb",)
}
SCRIPT_CODES = 200
CACHED_CHUNKS = 200_000
CACHED_CHARS = 64
_FORMS = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>")


def width_table() -> dict[int, str]:
    """Characters without width to nothing, blanks to a blank, wide, positional and joined letters to plain ones.

    Derived from the character database; the entries need no list of their own.
    """
    out: dict[int, str] = {}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if (
            kind == "Cf" and ch not in VISIBLE_FORMATS
        ) or (kind == "Cc" and ch not in LINE_CONTROLS) or ch in WIDTHLESS_MARKS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            out[cp] = ""
        elif kind == "Zs" or ch in BLANK_LETTERS:
            out[cp] = " "
        elif (parts := unicodedata.decomposition(ch)).startswith("<"):
            tag, *codes = parts.split()
            plain = "".join(chr(int(c, 16)) for c in codes)
            if tag in _FORMS or (tag == "<compat>" and len(codes) > 1 and kind[0] == "L" and plain.isalpha()):
                out[cp] = unicodedata.normalize("NFKC", ch)
    out.pop(ord(" "), None)
    return out


def shape_table(spark: SparkSession) -> dict[int, str]:
    """Letters of any script to the Latin letter of the same shape.

    Built from the published confusable data that Spark's own JVM carries (ICU): a letter maps to the
    ASCII letter with the same skeleton, else to the first undecomposable Latin letter of its case with it; where
    two ASCII letters share a skeleton, case decides.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = [chr(c) for c in range(0x41, 0x1F000) if chr(c).isalpha() and not (0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3)]
    skeleton = dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True))
    twins: dict[str, list[str]] = {}
    for a in ASCII_LETTERS:
        twins.setdefault(skeleton[a], []).append(a)
    ascii_shapes = set(twins)
    for a in letters:
        if skeleton[a] not in ascii_shapes and _latin.match(a) and not unicodedata.decomposition(a):
            twins.setdefault(skeleton[a], []).append(a)
    out = {}
    for ch, s in skeleton.items():
        if s in twins and ch not in ASCII_LETTERS:
            same_case = [a for a in twins[s] if a.isupper() == ch.isupper()]
            twin = (same_case or twins[s])[0]
            if twin != ch and (same_case or twin in ASCII_LETTERS):
                out[ord(ch)] = twin
    return out | {ord(k): v for k, v in SHAPE_FIXES.items()}


def script_names(spark: SparkSession) -> tuple[str, ...]:
    """Names of all scripts of the character database (from the ICU that Spark's JVM carries) that ``regex`` knows."""
    scripts = spark._jvm.com.ibm.icu.lang.UScript
    found = []
    for name in {scripts.getName(k) for k in range(SCRIPT_CODES)}:
        try:
            regex.compile(rf"\p{{scx={name}}}")
            found.append(name)
        except regex.error:
            continue
    return tuple(sorted(found))


class _Chunks(dict):
    """Forms of the pieces between blanks that a worker has seen; long pieces are not kept."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        made = self.make(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = made
        return made


class Canon:
    """Brings texts to the consistent form; cheap to pickle, builds its indexes on first use."""

    def __init__(self, widths: dict[int, str], shapes: dict[int, str], scripts: tuple[str, ...], by_script: bool = True):
        """``by_script=False`` leaves every token in its stored letters: the remaining steps alone."""
        self.widths, self.shapes, self.scripts, self.by_script = widths, shapes, scripts, by_script

    @classmethod
    def of(cls, spark: SparkSession, by_script: bool = True) -> Canon:
        return cls(width_table(), shape_table(spark), script_names(spark), by_script)

    def __getstate__(self) -> dict:
        return {"widths": self.widths, "shapes": self.shapes, "scripts": self.scripts, "by_script": self.by_script}

    @cached_property
    def _patterns(self) -> list[tuple[str, regex.Pattern]]:
        return [(s, regex.compile(rf"\p{{scx={s}}}")) for s in self.scripts]

    @cached_property
    def _known(self) -> dict[str, frozenset[str] | None]:
        return {}

    def scripts_of(self, ch: str) -> frozenset[str] | None:
        """Scripts that a character belongs to, writing systems included; None where it goes with any script."""
        if ch not in self._known:
            own = {s for s, p in self._patterns if p.match(ch)}
            for script, systems in SYSTEMS.items():
                if script in own:
                    own.update(systems)
            self._known[ch] = None if not own or own & {"Common", "Inherited", "Unknown"} else frozenset(own)
        return self._known[ch]

    @cached_property
    def spellings(self) -> dict[str, dict[str, str]]:
        """Per script other than Latin: Latin letter to the script's letter of that shape (the first in code order)."""
        out: dict[str, dict[str, str]] = {}
        for cp, latin in sorted(self.shapes.items()):
            for s in (self.scripts_of(chr(cp)) or frozenset()) - {LATIN}:
                out.setdefault(s, {}).setdefault(latin, chr(cp))
        return out

    @cached_property
    def _writers(self) -> dict[str, frozenset[str]]:
        out: dict[str, set[str]] = {a: {LATIN} for a in ASCII_LETTERS}
        for latin in self.shapes.values():
            out.setdefault(latin, {LATIN})
        for s, spell in self.spellings.items():
            for latin in spell:
                out[latin].add(s)
        return {k: frozenset(v) for k, v in out.items()}

    def look(self, ch: str) -> str:
        """The letter that stands for all letters of one shape: the Latin one, or the letter itself."""
        return self.shapes.get(ord(ch), ch)

    def writers(self, ch: str) -> frozenset[str] | None:
        """Scripts with a letter of this shape; None: any."""
        twin = self.look(ch)
        return self._writers.get(twin) or self.scripts_of(twin)

    def resolve(self, token: str) -> tuple[str, str | None]:
        """``(kind, script)`` of a decomposed token: its confusable kind and the script selected for it (None: no single one).

        Kinds: ``single`` (one script and no other could write it), ``whole`` (one script, but another
        could write it too), ``mixed`` (several scripts, but one could write it), ``no script`` (several
        scripts and none could write it all).
        """
        resolved: frozenset[str] | None = None
        able: frozenset[str] | None = None
        for ch in {c for c in token if unicodedata.category(c)[0] == "L"}:
            if (own := self.scripts_of(ch)) is not None:
                resolved = own if resolved is None else resolved & own
            if (can := self.writers(ch)) is not None:
                able = can if able is None else able & can
        selected = LATIN if able is None or LATIN in able else min(able, default=None)
        if resolved is None or (resolved and selected is None):
            return "single", selected
        if resolved:
            return ("whole" if able and able - resolved else "single"), selected
        return ("mixed" if selected else "no script"), selected

    def spell(self, token: str, script: str | None) -> str:
        """A decomposed token in the letters of the selected script."""
        letters = self.spellings.get(script, {}) if script not in (None, LATIN) else {}
        return "".join(letters.get(twin, twin) for twin in map(self.look, token))

    @cached_property
    def _spelled(self) -> _Chunks:
        def spelled(token: str) -> str:
            apart = unicodedata.normalize("NFD", token)
            return unicodedata.normalize("NFC", self.spell(apart, self.resolve(apart)[1]))

        return _Chunks(spelled)

    def _token(self, m: regex.Match) -> str:
        token = m[0]
        return token if token.isascii() or not self.by_script else self._spelled[token]

    def chunk(self, text: str) -> str:
        """The form of a text, piece by piece; pieces between blanks never touch each other."""
        if text.isascii():
            return _CONTROL.sub("", text)
        return _TOKEN.sub(self._token, unicodedata.normalize("NFC", text.translate(self.widths)))

    @cached_property
    def _forms(self) -> _Chunks:
        return _Chunks(self.chunk)

    def __call__(self, text: str) -> str:
        if text.isascii():
            return _CONTROL.sub("", text)
        return " ".join(map(self._forms.__getitem__, text.split(" ")))

    def kinds(self, text: str) -> Counter[str]:
        """How many tokens with a letter outside ASCII are of each kind."""
        found: Counter[str] = Counter()
        for token in _TOKEN.findall(unicodedata.normalize("NFC", text.translate(self.widths))):
            if not token.isascii():
                apart = unicodedata.normalize("NFD", token)
                kind, script = self.resolve(apart)
                found["respelled" if kind == "single" and self.spell(apart, script) != apart else kind] += 1
        return found


def forms(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(<id>, form)`` of every document; a null text has a null form."""
    spark = docs.sparkSession
    canon = spark.sparkContext.broadcast(Canon.of(spark))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = canon.value
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "form": [None if t is None else make(t) for t in pdf["t"]]})

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t")).mapInPandas(run, f"id {kind}, form string")
    return rows.withColumnRenamed("id", id_column)


def look_keys(docs: DataFrame) -> DataFrame:
    """``(doc_id, form, raw)``: 128-bit digests of the form and of the stored text.

    Documents without a visible character (null, empty, blank) or without an id are left out.
    """
    spark = docs.sparkSession
    canon = spark.sparkContext.broadcast(Canon.of(spark))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = canon.value
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        for pdf in frames:
            ids, a, b = [], [], []
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                if t is None or not (form := make(t)) or form.isspace():
                    continue
                ids.append(i)
                a.append(digest(form))
                b.append(a[-1] if form == t else digest(t))
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "form": a, "raw": b})

    return docs.select("doc_id", "text").where(
        F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    ).mapInPandas(run, "doc_id long, form string, raw string")


def script_report(docs: DataFrame) -> DataFrame:
    """``(kind, n_tokens, n_docs)`` over all tokens with a letter outside ASCII; see :meth:`Canon.resolve`.

    ``respelled`` are tokens of one script that still hold letters of another block of it.
    """
    spark = docs.sparkSession
    canon = spark.sparkContext.broadcast(Canon.of(spark))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, tokens, owners = canon.value, Counter(), Counter()
        for pdf in frames:
            for t in pdf["text"]:
                if t is not None and not t.isascii():
                    found = make.kinds(t)
                    tokens.update(found)
                    owners.update(found.keys())
        yield pd.DataFrame([(k, n, owners[k]) for k, n in tokens.items()], columns=["kind", "t", "d"])

    sums = docs.select("text").mapInPandas(run, "kind string, t long, d long")
    return sums.groupBy("kind").agg(F.sum("t").alias("n_tokens"), F.sum("d").alias("n_docs"))


def look_alike_pairs(docs: DataFrame) -> DataFrame:
    """``(doc_a, doc_b)``, doc_a < doc_b: different stored texts of one form.

    Exact copies are never compared: the distinct spellings of a form are paired first, and documents are
    attached to both sides after.  A spelling may hold a third of all documents, so its documents are
    dealt to shards and its pairs repeated for those shards only.
    """
    keys = cut(look_keys(docs))  # two digests a document, instead of a second pass over all texts
    spellings = keys.groupBy("form", "raw").agg(F.count("*").alias("n"))
    several = spellings.withColumn("m", F.count("*").over(Window.partitionBy("form"))).where(F.col("m") > 1).select("form", "raw")
    pairs = several.select("form", F.col("raw").alias("raw_a")).join(
        several.select("form", F.col("raw").alias("raw_b")), "form"
    ).where(F.col("raw_a") < F.col("raw_b")).select("raw_a", "raw_b")
    rows = keys.select("doc_id", "raw")
    plan = plan_loads(rows, "raw")
    side = lambda pairs, key, name: fragment_replicate_join(
        rows.select(F.col("raw").alias(key), F.col("doc_id").alias(name)), pairs, key, "inner", plan
    )
    both = side(side(pairs, "raw_a", "x").select("raw_b", "x"), "raw_b", "y")
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def look_alike_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id, n_docs, n_spellings, n_links)`` of every document with a visible character.

    The class is the smallest doc_id of its form; ``n_links`` counts the documents of the class that are
    spelled otherwise.  Copies are not expanded to pairs.
    """
    keys = cut(look_keys(docs))
    spellings = keys.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    form = Window.partitionBy("form")  # a row per spelling
    classes = spellings.select(
        "raw",
        F.min("least").over(form).alias("class_id"),
        F.sum("n").over(form).alias("n_docs"),
        F.count("*").over(form).alias("n_spellings"),
        (F.sum("n").over(form) - F.col("n")).alias("n_links"),
    )
    found = fragment_replicate_join(keys.select("doc_id", "raw"), classes, "raw", "inner")
    return found.select("doc_id", "class_id", "n_docs", "n_spellings", "n_links")
