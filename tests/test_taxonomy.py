"""Categories of texts against a naive loop over the rules."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import taxonomy
from quarry.operators.taxonomy import RULES, Rule

RNG = random.Random(3)


def naive(text, rules, default=taxonomy.DEFAULT):
    text = text.lower()
    for n, r in enumerate(rules):
        if any(b and all(any(t and t.lower() in text for t in g) for g in b) for b in r.branches):
            return r.category, list(r.weaknesses), n
    return default[0], list(default[1]), -1


def told(spark, texts, rules):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", taxonomy.classified(["t"], rules).alias("k")).select("i", "k.*").collect()
    return [(r.category, r.weaknesses, r.rule) for r in sorted(rows, key=lambda r: r.i)]


def random_rules():
    term = lambda: "".join(RNG.choice("abC ") for _ in range(RNG.randint(1, 4)))
    return [Rule(f"c{i}", (f"CWE-{i}",) * (i % 2), tuple(tuple(tuple(term() for _ in range(RNG.randint(1, 3))) for _ in range(RNG.randint(1, 3))) for _ in range(RNG.randint(0, 3)))) for i in range(8)]


@pytest.mark.parametrize("_", range(4))
def test_rules_match_a_naive_loop(spark, _):
    rules = random_rules()
    texts = ["", "   ", None, *["".join(RNG.choice("abcC") if RNG.random() < 0.8 else " " for _ in range(RNG.randint(0, 30))) for _ in range(150)]]
    assert told(spark, texts, rules) == [naive(t or "", rules) for t in texts]


def test_the_rules_of_the_library(spark):
    texts = ["A hard-coded API key", "a Default Password is set", "pickle deserializes untrusted bytes", "SQL is concatenated", "SQL is concatenated from a request", "unescaped HTML", "x" * 2_000_000 + " xss", "nothing"]
    assert [r[0] for r in told(spark, texts, RULES)] == ["hard-coded-credential", "hard-coded-credential", "unsafe-deserialization", "security-defect", "sql-injection", "cross-site-scripting", "cross-site-scripting", "security-defect"]


def test_terms_may_overlap_and_rules_be_few(spark):
    rules = [Rule("both", ("CWE-1",), ((("she",), ("he",), ("hers",)),)), Rule("never", (), ()), Rule("empty", (), ((("",),), ((),)))]
    assert told(spark, ["ushers", "she"], rules) == [("both", ["CWE-1"], 0), ("security-defect", [], -1)]
    assert told(spark, ["any"], []) == [("security-defect", [], -1)]


def test_texts_meet_in_one_and_tables_hold_rules(spark):
    rows = [(2, "late", ["CWE-2"], 0, 0, "b"), (1, "early", ["CWE-1", "CWE-9"], 0, 0, "a"), (1, "early", ["CWE-1", "CWE-9"], 0, 1, "b"), (1, "early", None, 1, 0, None), (2, "late", ["CWE-2"], 0, 0, "")]
    rules = taxonomy.rules_of(spark.createDataFrame(rows, "priority int, category string, weaknesses array<string>, branch int, group int, term string"))
    assert rules == [Rule("early", ("CWE-1", "CWE-9"), ((("a",), ("b",)),)), Rule("late", ("CWE-2",), ((("b",),),))]
    df = spark.createDataFrame([("A", "b", 7), (None, "b", 8), ("x y", None, 9)], "s string, t string, category int")
    got = df.select("category", taxonomy.classified(["s", F.col("t")], rules).alias("k")).collect()
    assert [(r.category, r.k.category) for r in got] == [(7, "early"), (8, "late"), (9, "security-defect")]


def test_an_empty_table(spark):
    assert spark.createDataFrame([], "t string").select(taxonomy.classified(["t"])).collect() == []
