"""The learned operators against plain reference models of their definitions."""

import math
import random
from collections import Counter

import pytest

from quarry.llm import langid, pst

RND = random.Random(31)


def naive_scores(texts, train, depth):
    """Base and model log10 scores by dictionaries over whole sequences."""
    seqs = [[b"\n\n", *pst.normal(t)] for t in texts]
    counts = Counter(tuple(s[i : i + k]) for s, tr in zip(seqs, train) if tr for k in range(1, depth + 2) for i in range(len(s) - k + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != (b"\n\n",))
    v = sum(len(g) == 1 and g != (b"\n\n",) for g in counts)
    p = [[(counts[(w,)] + 0.1) / (n + 0.1 * (v + 1)) for w in s] for s in seqs]
    base = [sum(map(math.log10, x[1:])) for x in p]
    for d in range(1, depth + 1):
        better, gains = {}, Counter()
        for a, (s, tr) in enumerate(zip(seqs, train)):
            for i in range(d, len(s)):
                c = tuple(s[i - d : i])
                if counts[c] >= pst.MIN_COUNT:
                    share = pst.weight(counts[c])
                    better[a, i] = (counts[(*c, s[i])] + share * p[a][i]) / (counts[c] + share)
                    if tr:
                        gains[c] += math.log(better[a, i] / p[a][i])
        for (a, i), x in better.items():
            if gains[tuple(seqs[a][i - d : i])] >= pst.MIN_GAIN:
                p[a][i] = x
    return base, [sum(map(math.log10, x[1:])) for x in p]


@pytest.mark.parametrize("depth", [1, 3])
def test_suffix_tree_matches_a_plain_model(spark, depth):
    phrases = [[f"w{RND.randrange(30)}" for _ in range(RND.randrange(2, 6))] for _ in range(12)]
    texts = [" ".join(w for _ in range(RND.randrange(1, 20)) for w in RND.choice(phrases)) for _ in range(80)]
    texts += [texts[3], texts[3], None, "", "one unseen Word", " \n", "LONG " * 500]
    train = [i % 4 != 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i if i % 9 else None, t, tr, "x") for i, (t, tr) in enumerate(zip(texts, train))], "doc_id long, text string, tr boolean, block string")
    got = pst.score_texts(df, "tr", depth=depth, block_bytes=700).collect()
    base, score = naive_scores(texts, train, depth)
    told = sorted((i if i % 9 else -1, len(pst.normal(t)), round(b, 6), round(s, 6)) for i, (t, b, s) in enumerate(zip(texts, base, score)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == told
    assert sum(score) > sum(base)


def test_language_scores_sum_all_segmentations_of_long_words():
    import numpy as np

    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abcabcabcabcabc", b"bc", b"bcab", b" abc"})
    lattice = langid.Lattice(pieces)
    p = np.random.default_rng(4).uniform(0.001, 0.05, (len(pieces) + 1, 2))
    p[-1] = 0
    words = [b"abc" * n for n in (1, 20, 21, 22, 100, 700)] + [b"x" * 63, b"x" * 64, b"\xff" * 65]
    got = lattice.loglik(words, p)
    for w, row in zip(words, got):
        text = b" " + w
        for g in range(2):
            ways = [0.0] + [-math.inf] * len(text)
            for e in range(1, len(text) + 1):
                for q in [ways[e - len(x)] + math.log(p[i, g]) for i, x in enumerate(pieces) if text[max(0, e - len(x)) : e] == x]:
                    hi, lo = max(ways[e], q), min(ways[e], q)
                    ways[e] = hi + math.log1p(math.exp(lo - hi))
            assert row[g] == pytest.approx(ways[-1], rel=1e-9)


def test_language_pieces_sum_to_one_and_ties_and_long_texts_are_told(spark):
    rows = [(i, ("der die und nicht " if i % 2 else "the and with this ") * 5, "de" if i % 2 else "en") for i in range(40)]
    pieces = langid.load_pieces()
    assert max(map(len, pieces)) > 10
    names, p = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), pieces)
    assert p.sum(axis=0) == pytest.approx([1, 1])
    even = p.copy()
    even[:, 1] = even[:, 0]
    asked = spark.createDataFrame([(1, "und die " * 50_000, 7), (2, "the" * 30_000, 7)], "doc_id long, text string, lang_pred int")
    assert [r.lang_pred for r in langid.identify(asked, names, p, pieces).orderBy("doc_id").collect()] == ["de", "en"]
    assert {r.lang_pred for r in langid.identify(asked, names, even, pieces).collect()} == {"de"}
