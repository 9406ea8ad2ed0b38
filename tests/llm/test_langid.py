"""Sums over segmentations of words of any length and script, against sums over prefixes in logarithms."""

import math
import random

import numpy as np
import pytest

from quarry.llm import langid

RNG = random.Random(14)
PIECES = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b" ab", b"abab", "ก".encode(), "กก".encode(), b"a" * 20})
P = np.random.default_rng(3).uniform(1e-6, 1e-2, (len(PIECES) + 1, 2))
P[-1] = 0


def told(word, g):
    """log likelihood of a word, and the expected counts of its pieces, by exact logarithms."""
    text = b" " + word
    n, at = len(text), {p: i for i, p in enumerate(PIECES)}
    longest = max(map(len, PIECES))
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    a, b = [0.0] + [0.0] * n, [0.0] * n + [0.0]
    for e in range(1, n + 1):
        a[e] = add([a[s] + math.log(P[at[text[s:e]], g]) for s in range(max(0, e - longest), e) if text[s:e] in at])
    for s in range(n - 1, -1, -1):
        b[s] = add([b[e] + math.log(P[at[text[s:e]], g]) for e in range(s + 1, min(n, s + longest) + 1) if text[s:e] in at])
    counts = np.zeros(len(PIECES))
    for s in range(n):
        for e in range(s + 1, min(n, s + longest) + 1):
            if text[s:e] in at:
                counts[at[text[s:e]]] += math.exp(a[s] + math.log(P[at[text[s:e]], g]) + b[e] - a[n])
    return a[n], counts


WORDS = ["a", "abab", "ก" * 21, "𐍈" * 15, "a" * 700, "ab" * 33, "é" * 30, *("".join(RNG.choice("abก𐍈é") for _ in range(k)) for k in range(1, 71, 3))]


def test_words_of_any_length_are_summed_exactly(monkeypatch):
    lattice, words = langid.Lattice(PIECES), [w.encode() for w in WORDS]
    exact = np.array([[told(w, g)[0] for g in (0, 1)] for w in words])
    np.testing.assert_allclose(lattice.loglik(words, P), exact, rtol=1e-9)
    monkeypatch.setattr(langid, "WORDS", 3)
    np.testing.assert_allclose(lattice.loglik(words, P), exact, rtol=1e-9)


def test_expected_counts_span_whole_words():
    words = [w.encode() for w in WORDS]
    weight = np.arange(1.0, len(words) + 1)
    exact = sum(n * told(w, 1)[1] for w, n in zip(words, weight))
    np.testing.assert_allclose(langid.Lattice(PIECES).expected(words, weight, P[:, 1]), exact, rtol=1e-7, atol=1e-12)


def test_a_text_does_not_depend_on_its_neighbours(spark):
    rows = [(i, ("der die und nicht " if i % 2 else "the and with this ") * 5, "de" if i % 2 else "en") for i in range(40)]
    pieces = langid.load_pieces()
    names, p = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), pieces)
    odd = [c * n for c in ("x", "é", "ก", "𐍈", "\U0001f600") for n in range(8, 71, 6)]
    texts = [t for w in odd for t in (w, "und nicht die", f"the {w} with", "", "with the and")]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in langid.identify(asked, names, p, pieces).collect()}
    assert all(math.isfinite(r.score) and 0 <= r.score <= 1 for r in got.values())
    plain = {t: (got[i].lang_pred, got[i].score) for i, t in enumerate(texts[:5])}
    for i, t in enumerate(texts):
        if t in plain:
            assert (got[i].lang_pred, got[i].score) == (plain[t][0], pytest.approx(plain[t][1], abs=1e-12))
    assert plain["und nicht die"][0] == "de" and plain["with the and"][0] == "en"
