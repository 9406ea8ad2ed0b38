"""Near words against every two words compared, in light, split and crowded groups."""

import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quarry.llm import spelling

RNG = random.Random(12)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def edited(w, letters):
    i = RNG.randrange(len(w))
    return RNG.choice([w[:i] + w[i + 1 :], w[:i] + RNG.choice(letters) + w[i + 1 :], w[:i] + RNG.choice(letters) + w[i:]])


@pytest.mark.parametrize(("letters", "group_words", "levels"), [("abcdefghijklmnopéÿÀ", 400, 2), ("abcdefghijklmnopéÿÀ", 4, 2), ("acgt", 5, 1), ("acgt", 3, 0), ("ab", 1, 2)])
def test_near_words_match_brute_force(spark, letters, group_words, levels):
    words = {"".join(RNG.choice(letters) for _ in range(RNG.randrange(4, 9))) for _ in range(150)}
    words = sorted(words | {edited(w, letters) for w in words} | {"aaaaa", "aaaa", "aaaaaa", "abaaa"})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = [(r.word, r.n, r.other, r.other_n) for r in spelling.near_words(df, group_words, levels).collect()]
    told = {(a, b) for a in words for b in words if near(a, b)}
    assert len(got) == len(told) and {(a, b) for a, _, b, _ in got} == told and all(words[n] == a and words[m] == b for a, n, b, m in got)


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_some_key_misses_any_two_bits(levels):
    keys = spelling.band_keys(levels)
    assert len(keys) == 3 ** (levels + 1)
    assert all(any(not k >> a & 1 and not k >> b & 1 for k in keys) for a in range(spelling.BITS) for b in range(spelling.BITS))


def test_an_edit_flips_at_most_two_bits(spark):
    letters = "abcxyzàéÿßñÐ"
    pairs = [(w, edited(w, letters)) for w in ("".join(RNG.choice(letters) for _ in range(9)) for _ in range(500))]
    df = spark.createDataFrame(pairs, "a string, b string")
    flips = F.bit_count(spelling.parity_mask(F.col("a")).bitwiseXOR(spelling.parity_mask(F.col("b"))))
    assert df.agg(F.max(flips)).first()[0] == 2


def test_variants_of_odd_rows(spark):
    text = "Größe grösse GRÖSSE größe größe größe größes größer größer größer hello hello hello hello hello hello helo helo helo hellos hellos hellos"
    rows = [(1, text), (8, text), (9, text), (2, None), (None, "hello x" + "abcde" * 3000), (1, text), (3, ""), (4, "ab1cd éÀÿ×÷")]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n int, word string")
    seen = Counter()
    for i, t in rows:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = crc32(f"{'' if i is None else i}:{run}".encode())
                at = h % len(run)
                seen[run[:at] + run[at + 1 :] if h % 11 == 0 else run] += 1
                run = ""
    words = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    told = {}
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        best = others[0] if others and -others[0][0] >= 2 * n else None
        told[w] = [w, best and best[1], w, n, len(others), best and -best[0]]
    for row in told.values():
        while told[row[2]][1]:
            row[2] = told[row[2]][1]
    got = spelling.variants(spelling.vocabulary(spelling.runs(df, slip=11)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(list, got.collect()), key=str) == sorted(told.values(), key=str) and any(r[1] for r in told.values()) and {r[4] for r in told.values()} > {0, 1}
    assert spelling.variants(spelling.vocabulary(spelling.runs(df.limit(0)))).count() == 0


def test_roots_of_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w5"), ("y", "z")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert got == {**{f"w{i}": "w40" for i in range(40)}, "x": "w40", "y": "z"}
