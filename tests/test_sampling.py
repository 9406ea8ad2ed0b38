"""Bounded samples, windows, places and case folding against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import sampling
from quarry.operators.history import text_search

RNG = random.Random(11)


def plain_diverse(rows, most):
    """rows: (id, score, single key, array key)."""
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    seen, turns = {}, {}
    for r in order:
        for v in [("one", r[2]), *[("many", x) for x in (r[3] or [None])]]:
            seen[v] = seen.get(v, 0) + 1
            turns[r[0]] = min(turns.get(r[0], 10**9), seen[v])
    return [(r[0], turns[r[0]]) for r in sorted(order, key=lambda r: (turns[r[0]], -r[1], r[0]))[:most]]


@pytest.mark.parametrize("most", [0, 1, 7, 40, 1000])
def test_samples_match_a_walk(spark, most):
    rows = [(i, RNG.randrange(6), RNG.choice(["a", "a", "a", "b", None]), RNG.choice([None, [], ["x"], ["x", "y"], ["z", "x"]])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, score long, one string, many array<string>")
    got = sampling.diverse(df, "id", ["one", "many"], [F.desc("score"), F.col("id")], most).collect()
    assert [(r.id, r.turn) for r in got] == plain_diverse(rows, most)


def test_rare_kinds_stay_and_tasks_drop_the_rest_before_the_shuffle(spark):
    df = spark.range(0, 50_000, 1, 8).select("id", F.when(F.col("id") == 17, "rare").otherwise("common").alias("kind"))
    found = sampling.diverse(df, "id", ["kind"], [F.desc("id")], 5)
    assert 17 in {r.id for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    limits = [i for i, l in enumerate(plan.splitlines()) if "WindowGroupLimit" in l]
    exchange = [i for i, l in enumerate(plan.splitlines()) if "hashpartitioning(_v" in l]
    assert limits and exchange and max(limits) > min(exchange)  # a limit below the exchange: on the sending side


def plain_windows(hits, reach, most):
    out = {}
    for path in {p for p, _, _ in hits}:
        lines = sorted({l for p, l, _ in hits if p == path})
        start = last = None
        for l in lines:
            if last is None or l - last > reach:
                start = l
            last = l
            out.setdefault((path, start, (l - start) // most), []).extend((l, c) for p, x, c in hits if p == path and x == l)
    return {(k[0], min(l for l, _ in v), max(l for l, _ in v), len(set(v)), tuple(sorted({c for _, c in v}))) for k, v in out.items()}


@pytest.mark.parametrize(("reach", "most"), [(4, 16), (1, 3), (0, 16), (50, 2)])
def test_windows_match_a_walk(spark, reach, most):
    hits = [(RNG.choice("pq"), RNG.randrange(150), RNG.choice(["a", "b", "c"])) for _ in range(120)]
    df = spark.createDataFrame([*hits, (None, 1, "a"), ("p", None, "a"), hits[0]], "path string, line int, category string")
    rows = sampling.evidence_windows(df, "path", "line", "category", reach, most).collect()
    assert {(r.path, r.start_line, r.end_line, r.hits, tuple(r.categories)) for r in rows} == plain_windows(hits, reach, most)
    assert len(rows) == len(plain_windows(hits, reach, most)) and all(r.end_line - r.start_line < most for r in rows)


def test_places_without_one_window_over_all(spark):
    values = [RNG.randrange(300) for _ in range(5000)] + [None] * 9
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long").repartition(7)
    got = {r.i: r.place for r in sampling.placed(df, [F.col("v"), F.col("i")]).collect()}
    due = {i: n + 1 for n, (i, _) in enumerate(sorted(enumerate(values), key=lambda t: (t[1] is not None, t[1] or 0, t[0])))}
    assert got == due
    assert sampling.placed(df.limit(0), [F.col("i")]).count() == 0


def test_a_locale_puts_accents_and_case_after_letters(spark):
    words = ["Zebra", "zebra", "étude", "etude", "Étude", "eta", "f", "äpfel", "apfel", "Apfel", "b"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = sampling.placed(df, [F.collate("w", "UNICODE"), F.col("w")]).orderBy("place").collect()
    assert [r.w for r in rows] == ["apfel", "Apfel", "äpfel", "b", "eta", "etude", "étude", "Étude", "f", "zebra", "Zebra"]


def test_folding_of_all_letters(spark):
    import unicodedata

    letters = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    df = spark.createDataFrame([(c,) for c in letters], "c string").select("c", T.casefold(F.col("c")).alias("one"), T.casefold(F.concat(F.lit("Aı"), "c")).alias("last"), T.casefold(F.concat("c", F.lit("b"))).alias("first"))
    #: Letters of later editions of the Unicode tables than the JVM's.
    wrong = {r.c for r in df.collect() if (r.one, r.last, r.first) != (r.c.casefold(), ("Aı" + r.c).casefold(), (r.c + "b").casefold())}
    assert all(ord(c) in {0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC, *range(0x10D50, 0x10D66)} for c in wrong), sorted(map(hex, map(ord, wrong)))


def test_search_without_regard_to_case(spark):
    df = spark.createDataFrame([("Hauptstraße", None), ("STRASSE", "x"), ("ΣΊΣΥΦΟΣ", "y"), (None, None)], "a string, b string")
    hit = lambda q: [r.a for r in df.where(text_search(q, "a", "b")).collect()]
    assert hit("STRASSE") == hit("straße") == ["Hauptstraße", "STRASSE"] and hit("φος") == ["ΣΊΣΥΦΟΣ"] and len(hit(" ")) == 4
