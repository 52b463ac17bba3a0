"""Problem operators against brute force on small and odd inputs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import dedup, orphans, packed, rolling, skew, units

T0 = datetime(2024, 1, 1)


# skew


def keyed(spark, hot=3000, others=300):
    rows = [("HOT", k % 7) for k in range(hot)] + [(f"k{k % 40}", k) for k in range(others)] + [(None, 1)] * 20
    return spark.createDataFrame(rows, "key string, v long")


def test_skew_plan_places_shards(spark):
    df = keyed(spark)
    plan = skew.plan_loads(df, "key", 8)
    assert plan.total == 3320 and list(plan.salts) == ["HOT"] and len(plan.salts["HOT"]) >= 7
    assert max(plan.loads) < 2 * plan.total / 8
    salted = plan.scatter(df.where("key IS NOT NULL"), "key").groupBy(
        F.pmod(F.hash("key", skew.SALT), F.lit(8)).alias("p")
    ).count().collect()
    assert max(r["count"] for r in salted) < 2 * 3320 / 8  # Spark's own partitioner spreads the hot key


def test_skew_totals_and_join(spark):
    df = keyed(spark)
    plan = skew.plan_loads(df, "key", 8)
    got = skew.balanced_totals(
        df, "key", [F.count("*").alias("n"), F.sum("v").alias("s")], [F.sum("n").alias("n"), F.sum("s").alias("s")], plan
    )
    want = defaultdict(lambda: [0, 0])
    for r in df.where("key IS NOT NULL").collect():
        want[r["key"]][0] += 1
        want[r["key"]][1] += r["v"]
    assert {r["key"]: [r["n"], r["s"]] for r in got.collect()} == dict(want)
    right = spark.createDataFrame([("HOT", "a"), ("HOT", "b"), ("k1", "c"), (None, "d")], "key string, w string")
    for how in ("inner", "left"):
        mine = Counter(map(tuple, skew.fragment_replicate_join(df, right, "key", how, plan).select("key", "v", "w").collect()))
        assert mine == Counter(map(tuple, df.join(right, "key", how).select("key", "v", "w").collect()))
    with pytest.raises(ValueError, match="how"):
        skew.fragment_replicate_join(df, right, "key", "outer", plan)


def test_skew_hot_and_empty(spark):
    df = keyed(spark)
    assert [r["key"] for r in skew.hot_keys(df, "key", 0.03).collect()] == ["HOT"]
    edge = spark.createDataFrame([("a",)] * 3 + [(f"x{k}",) for k in range(97)], "key string")
    assert [r["key"] for r in skew.hot_keys(edge, "key", 0.03).collect()] == ["a"]
    assert skew.hot_keys(df.limit(0), "key", 0.03).count() == 0
    nulls = spark.createDataFrame([(None,)] * 3, "key string")
    assert skew.hot_keys(nulls, "key", 0.03).count() == 0


def test_murmur_matches(spark):
    h = spark.range(1).select(F.hash(F.lit("abc"))).first()[0]
    want = [r[0] for r in spark.range(50).select(F.hash(F.lit("abc"), F.col("id").cast("int"))).collect()]
    assert skew._murmur3_int(np.arange(50), h).tolist() == want


# orphans


def test_bitmap():
    rng = random.Random(1)
    for n, m in ((10, 200_000), (60_000, 100_000), (0, 5)):
        a, b = {rng.randrange(m) for _ in range(n)}, {rng.randrange(m) for _ in range(n)}
        x, y = (orphans.KeyBitmap.of(np.array(sorted(s), dtype=np.int64)) for s in (a, b))
        assert x.decode().tolist() == sorted(a) and x.and_not(y).decode().tolist() == sorted(a - b)


def test_orphans_brute_force(spark):
    rng = random.Random(3)
    at = lambda: None if rng.random() < 0.03 else T0 + timedelta(days=rng.randrange(120), seconds=rng.randrange(80_000))
    key = lambda: None if rng.random() < 0.05 else f"K{rng.randrange(60)}"
    children = [(s, key(), at()) for s in ("a", "b") for _ in range(600)]
    parents = [(s, key(), at()) for s in ("a", "b") for _ in range(50)]
    removals = [(s, key(), T0 + timedelta(days=rng.randrange(120))) for s in ("a", "b") for _ in range(15)]
    born, gone, known = {}, {}, set()
    for s, k, t in parents:
        known.add((s, k))
        if t:
            born[s, k] = min(t, born.get((s, k), t))
    for s, k, t in removals:
        gone[s, k] = min(t, gone.get((s, k), t))
    want = set()
    for s, k, t in children:
        if k is None:
            continue
        if (s, k) not in known:
            kind = "missing"
        elif t and (s, k) in gone and gone[s, k] <= t:
            kind = "deleted"
        elif t and (s, k) in born and born[s, k] > t:
            kind = "late"
        else:
            continue
        want.add((s, t.strftime("%Y-%m") if t else None, k, kind))
    schema = "src string, ref_key string, at timestamp_ntz"
    c, p, r = (spark.createDataFrame(x, schema) for x in (children, parents, removals))
    for size in (7, 50_000):
        got = [tuple(x) for x in orphans.orphan_references(c, p, r, size).select("src", "ref_month", "ref_key", "kind").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert orphans.orphan_references(c.limit(0), p, r).count() == 0
    assert {x["kind"] for x in orphans.orphan_references(c, p.limit(0), r.limit(0)).collect()} == {"missing"}


# rolling totals


def test_forest_brute_force():
    rng = np.random.default_rng(5)
    entity, day, total = [], [], []
    for e in range(6):
        days = np.unique(rng.integers(-70, 400, size=(1, 3, 40, 200, 7, 90)[e]))
        entity += [e] * len(days)
        day += days.tolist()
        total += rng.integers(0, 1000, size=len(days)).tolist()
    entity, day, total = map(np.array, (entity, day, total))
    forest = rolling.Forest.of_days(entity, day, total, np.ones(len(day), dtype=np.int64))
    e, d = forest.dates()
    for w in (1, 7, 30, 64, 200):
        want = [int(total[(entity == a) & (day <= b) & (day > b - w)].sum()) for a, b in zip(e, d, strict=True)]
        assert forest.window(e, d, w).tolist() == want


def test_rolling_frames(spark):
    rows = [
        ("A", T0, 5), ("A", T0 + timedelta(hours=3), None), ("A", T0 + timedelta(days=9), 7), (None, T0, 9), ("B", None, 4), ("C", T0, None)
    ]
    days = rolling.daily(spark.createDataFrame(rows, "e string, t timestamp_ntz, n long"), "e", "t", "n")
    got = {(r["entity"], r["day"] - 19723): (r["n_rows"], r["total_7"], r["total_30"]) for r in rolling.trailing_totals(days).collect()}
    assert got[("A", 0)] == (2, 5, 5) and got[("A", 6)] == (0, 5, 5) and got[("A", 7)] == (0, 0, 5) and got[("A", 9)] == (1, 7, 12) and got[("C", 0)] == (1, 0, 0) and len(got) == 11
    gaps = {(r["entity"], r["day"] - 19723) for r in rolling.trailing_totals(days, (7, 30), (7, 30)).collect()}
    assert gaps == {("A", d) for d in range(1, 7)}
    assert rolling.trailing_totals(days.limit(0)).count() == 0
    many = spark.createDataFrame(
        [(f"E{k}", d, k + d, 1) for k in range(40) for d in (0, 3, 60_000 + k)], "entity string, day int, total long, n_rows long"
    )
    whole = rolling.trailing_totals(many, (7,))  # more dates than are handled at once
    assert whole.count() == sum(60_001 + k for k in range(40)) and whole.where("total_7 > 0").count() == 40 * 11 - 3


def test_late_corrections(spark, tmp_path):
    """Corrected trees are those of all days together, in memory and as a stored table; other nodes and shards stay."""
    schema = "entity string, day int, total long, n_rows long"
    base = spark.createDataFrame([("A", 3, 10, 1), ("A", 70, 5, 1), ("B", -1, 2, 1)], schema)
    late = spark.createDataFrame([("A", 3, -4, 0), ("B", 200, 9, 1), ("A", 3, 1, 0)], schema)
    key = lambda df: {(r["entity"], r["shard"]): (list(r["totals"]), list(r["rows"])) for r in df.collect()}
    trees = rolling.tree_table(base)
    before, after = key(trees), key(rolling.correct_trees(trees, late))
    both = base.unionByName(late)
    assert after == key(rolling.tree_table(both)) and len(after) == 4
    changed = [sum(x != y for x, y in zip(a, before.get(k, ([0] * 128, 0))[0], strict=True)) for k, (a, _) in after.items()]
    assert sorted(changed) == [0, 0, 7, 7]
    path = str(tmp_path / "trees")
    rolling.write_trees(trees, path)
    untouched = {f for f in (tmp_path / "trees" / "shard=1").iterdir()}
    rolling.correct_stored(spark, path, late)
    stored = spark.read.parquet(path)
    assert key(stored) == after and {f for f in (tmp_path / "trees" / "shard=1").iterdir()} == untouched
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(rolling.answer(stored)) == rows(rolling.trailing_totals(both)) and rolling.answer(stored).count() == 68 + 202


# units


@pytest.mark.parametrize(
    ("number", "power", "want"),
    [
        ("12", 2, "1200"),
        ("1.25", 1, "13"),
        ("1.24", 1, "12"),
        ("0.00001", 18, "10000000000000"),
        ("994000", -2, "9940"),
        ("99", -2, "1"),
        ("49", -2, "0"),
        ("0", 5, "0"),
        ("-150", -2, "-2"),
        ("9" * 60, 3, "9" * 60 + "000"),
        ("999.9", 0, "1000"),
        ("007", 0, "7"),
        (None, 1, None)
    ]
)
def test_shift_text(spark, number, power, want):
    df = spark.createDataFrame([(number, power)], "n string, p int")
    assert df.select(units.shift_text(F.col("n"), F.col("p"))).first()[0] == want


def test_hex_text(spark):
    rng = random.Random(2)
    values = [0, 1, 2**32, 10**9, 2**256 - 1, *(rng.getrandbits(rng.randrange(1, 257)) for _ in range(60)), rng.getrandbits(3000)]
    df = spark.createDataFrame([(f"{v:x}", str(v)) for v in values], "h string, d string")
    assert df.where(units.hex_text(F.col("h")) != F.col("d")).count() == 0


def test_notes(spark):
    """Which clauses name the unit of the price is learnt from the dollar that both prices make."""
    names = {"cent": 2, "cents": 2, "¢": 2, "mill": 1, "tenth of a cent": 1, "bp": 0, "usd e-6": -2}
    table = units.UnitTable(names, {"rest": 2})
    rng = np.random.default_rng(5)
    rows = []
    for form in ("px:{} / fee:{}", "fee in {}", "px in {}", "[{}]", "fees: {}; px: {}", "price={};src=x"):
        for _ in range(60):
            unit, other = rng.choice(list(names), 2)
            price = int(rng.integers(1, 99)) * 10 ** (2 - names[unit])
            told = (other, unit) if form.startswith("fees") else (other,) if form.startswith("fee") else (unit, other)
            rows.append((form.format(*told), price, 10 ** (4 - names[unit]) - price))
    learn = spark.createDataFrame(rows, "note string, y long, n long")
    both = F.col("y") + F.col("n")
    dollar = lambda p: F.abs(both - 10 ** (4 - p)) <= 1
    others = units.other_contexts(learn, table.mentions(F.col("note")), both.isNotNull(), dollar, table.powers)
    assert len(others) == 3  # "fee:", "fee in" and "fees:"
    cases = {
        "px in Tenth of a Cent": 1, "[¢]": 2, "px:bp / fee:cent": 0, "fee in cent": None, "fee:cent / px:mill": 1, "price=USD E-6;src=x": -2,
        "millions": None, "": None, "ok": None, None: None, "yes/no quoted in cents": 2, "fees: mill; px: bp": 0,
    }
    df = spark.createDataFrame(list(cases.items()), "note string, want int")
    assert {r[0]: r[1] for r in df.select("note", table.named(F.col("note"), others)).collect()} == cases
    empty = units.UnitTable({}, {})
    assert df.where(empty.named(F.col("note")).isNotNull() | empty.default(F.col("note")).isNotNull()).count() == 0
    assert units.other_contexts(learn.limit(0), table.mentions(F.col("note")), both.isNotNull(), dollar, table.powers) == []


def test_posterior_takes_evidence(spark):
    """Two prices that make a dollar settle a unit; a pair that makes none is flagged, and so is a price between two units."""
    m = units.Mixture((2, 1, 0, -2), (0.25,) * 4, 4.0, 0.4)
    rows = [(60, 40, 2, True), (600, 401, 1, True), (6000, 4000, 0, True), (131900, 868100, -2, True), (60, 57, None, False), (0, 100, 2, True)]
    df = spark.createDataFrame(rows, "y long, n long, p int, sure boolean")
    both = F.col("y") + F.col("n")
    got = df.select("p", "sure", m.posterior(F.log10(both.cast("double")), lambda p: F.abs(both - 10 ** (4 - p)) <= 1).alias("g")).collect()
    assert all(r["g"]["power"] == r["p"] and r["g"]["sure"] is r["sure"] for r in got), got
    alone = spark.range(1).select(m.posterior(F.lit(2.5)).alias("g")).first()["g"]
    assert alone["power"] in (2, 1) and not alone["sure"]


def test_mixture(spark):
    rng = np.random.default_rng(0)
    powers = [2, 1, 0, -2]
    truth = rng.choice(powers, size=4000, p=[0.7, 0.15, 0.1, 0.05])
    values = np.round(10.0 ** (4 - truth) * 10 ** rng.normal(0, 0.1, size=4000)).astype(int)
    df = spark.createDataFrame([(int(v), int(p)) for v, p in zip(values, truth, strict=True)], "v long, p int")
    m = units.fit_units(df, F.col("v"), powers, 3.8)
    assert abs(m.centre - 4) < 0.02 and abs(m.width - 0.1) < 0.02
    got = df.select("p", m.posterior(F.log10("v")).alias("g")).select("p", "g.*").collect()
    assert sum(r["p"] == r["power"] for r in got) > 3990
    unsure = spark.range(1).select(m.posterior(F.lit(4 - 1.5)).alias("g")).first()["g"]
    assert unsure["probability"] < 0.99 and not unsure["sure"]
    assert units.Mixture.fit([], powers, 4.0).weights == (0.25,) * 4


# duplicates


def test_dedup(spark):
    rng = random.Random(4)
    rows = [
        (
            None if rng.random() < 0.05 else f"m{rng.randrange(80)}",
            None if rng.random() < 0.05 else T0 + timedelta(hours=rng.randrange(20)),
            rng.randrange(5)
        ) for _ in range(900)
    ]
    rows += [("hot", T0 + timedelta(minutes=k % 300), k % 3) for k in range(700)]
    df = spark.createDataFrame(rows, "id string, at timestamp_ntz, v int")
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    order = lambda r: (r[1] is None, r[1] or T0, r[2])
    want = Counter([min(g, key=order) for k, g in groups.items() if k is not None] + groups[None])
    plan = skew.plan_loads(df, "id", 8)
    assert "hot" in plan.salts
    for p in (None, plan):
        kept = dedup.keep_first(df, "id", "at", plan=p)
        assert kept.columns == df.columns and Counter(map(tuple, kept.collect())) == want
        assert {
            r["id"]: r["n_copies"] for r in dedup.copy_counts(df, "id", "at", plan=p).collect()
        } == {k: len(g) for k, g in groups.items() if k is not None and len(g) > 1}
    stored, batch = df.where("v < 2"), df.where("v >= 2")
    known = {r["id"] for r in stored.collect()} - {None}
    new = dedup.admit(stored, batch, "id", "at")
    assert {r["id"] for r in new.collect()} - {None} == {r[0] for r in rows if r[2] >= 2 and r[0]} - known
    assert dedup.admit(stored.unionByName(new), batch.where("id IS NOT NULL"), "id", "at").count() == 0
    assert dedup.keep_first(df.limit(0), "id", "at").count() == 0 and dedup.copy_counts(df.limit(0), "id", "at").count() == 0


# packed fields


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ('["Yes", "No"]', ["Yes", "No"]),
        ("['Yes','No']", ["Yes", "No"]),
        ("('a', '')", ["a", ""]),
        ("{Will open,Won't open}", ["Will open", "Won't open"]),
        ('["Ha\'penny", \'Groat\']', ["Ha'penny", "Groat"]),
        ('"[\\"S\\\\u00ec\\", \\"No\\"]"', ["Sì", "No"]),
        ('["\\"Old\\" x", "y"]', ['"Old" x', "y"]),
        ('"""Old"" x"; y', ['"Old" x', "y"]),
        ('{"a\\"b",c}', ['a"b', "c"]),
        ('Tie, Not a tie, ""', ["Tie", "Not a tie", ""]),
        ("Yes|No|", ["Yes", "No"]),
        (" Up ;Down ", ["Up", "Down"]),
        ("Over\tUnder", ["Over", "Under"]),
        ("a\n\"b, c\"\n", ["a", "b, c"]),
        ("[0.50, 1]", ["0.50", "1"]),
        ("[]", []),
        ("", []),
        ("   ", []),
        (None, []),
        ('""', [""]),
        ('["\\ud83d\\ude80"]', ["🚀"]),
        ("{'x', 'it''s'}", ["x", "it's"]),
    ],
)
def test_read_atoms(text, values):
    parsed = packed._parse(text)
    got = packed.readings(*parsed, packed.ValueModel.flat())[0][2] if parsed else []
    assert got == values


def test_packed_ambiguous(spark):
    rows = [
        ("m1", '["a","b"]', "0,5;0,5", None),
        ("m2", '["a","b","c","d"]', "0,1,0,0", None),
        ("m3", "a|b", "1,0", "x;y"),
        ("m4", None, "1,0,0,0", None),
        ("m4", '["a","b"]', None, None),
        ("m5", None, "0,25 | 0,75", ""),
        ("m6", None, "1,0", None)
    ]
    rows += [(f"p{k}", '["Yes","No"]', '["1","0"]', None) for k in range(30)] + [(None, "a,b", None, None)]
    df = spark.createDataFrame(rows, "id string, outcomes string, outcome_prices string, clob_token_ids string")
    got = defaultdict(dict)
    for r in packed.split_packed(df, "id").collect():
        got[r["id"], r["field_name"]][r["pos"]] = r["item"]
    value = lambda *k: [v for _, v in sorted(got[k].items())]
    assert value(
        "m1", "outcome_prices"
    ) == ["0,5", "0,5"] and value("m2", "outcome_prices") == ["0", "1", "0", "0"] and value("m3", "outcome_prices") == ["1", "0"]
    assert value("m4", "outcome_prices") == ["1,0", "0,0"]  # the record's other fetch has two values
    assert value(
        "m5", "outcome_prices"
    ) == ["0,25", "0,75"] and value("m6", "outcome_prices") == ["1", "0"] and value(None, "outcomes") == ["a", "b"]
    assert packed.split_packed(df.limit(0), "id").count() == 0


def test_packed_round_trip():
    rng = random.Random(9)
    import json

    writers = [
        json.dumps,
        lambda v: json.dumps(v, separators=(",", ":")),
        lambda v: json.dumps(json.dumps(v)),
        lambda v: ";".join('"' + x.replace('"', '""') + '"' for x in v),
        lambda v: "{" + ",".join('"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' for x in v) + "}"
    ]
    alphabet = "ab ,;|~'\"()é0.🚀"
    for _ in range(400):
        values = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 8))).strip() for _ in range(rng.randrange(2, 7))]
        for w in writers:
            parsed = packed._parse(w(values))
            assert parsed and [a for a, _ in parsed[0]] == values, (w(values), values)
