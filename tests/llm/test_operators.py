"""Each operator against brute force or an exact round trip, with nulls, empty tables, ties and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
import xxhash
from oracle import SF, same
from pyspark.sql import functions as F

from quarry.llm import decontam, embed, langid, mixing, pst, queries, sharding, simhash, substring, toxicity, warc

RNG = random.Random(3)
VOCAB = [f"w{i}" for i in range(60)]
LONG = " ".join(RNG.choice(VOCAB) for _ in range(400))
TEXTS = [None, "", "a", LONG, LONG, LONG[:900] + " changed " + LONG[900:], " ".join(RNG.choice(VOCAB) for _ in range(30)) + LONG[100:300], "Ünïcode ÀB cd " * 9, "\n\t ", "x" * 3000]
ROWS = [(i, t, "en" if i % 2 else None, "web" if i % 3 else None, 1, "clash") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def lower_words(t):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_langid_forward_sums_all_segmentations():
    import numpy as np

    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b" ab", b"bc"})
    p = np.full((len(pieces) + 1, 1), 0.01)
    p[-1] = 0
    # " abc": 4 bytes; segmentations counted by hand over the pieces
    ways = {b"": 1.0}
    text = b" abc"
    for e in range(1, 5):
        ways[text[:e]] = sum(ways[text[:s]] * 0.01 for s in range(e) if text[s:e] in pieces)
    assert langid.Lattice(pieces).loglik([b"abc"], p)[0, 0] == pytest.approx(math.log(ways[text]))


def test_langid_learns_and_abstains(spark, docs):
    rows = [(i, ("der die und nicht " if i % 2 else "the and with this ") * 5, "de" if i % 2 else "en") for i in range(40)]
    pieces = langid.load_pieces()
    names, p = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), pieces)
    asked = spark.createDataFrame([(1, "und nicht die"), (2, "with the and"), (3, None), (4, "12 34"), (4, "12 34")], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(asked, names, p, pieces).collect())
    assert got == [(1, "de"), (2, "en"), (3, "und"), (4, "und"), (4, "und")]
    assert langid.identify(docs.limit(0), names, p, pieces).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, [], p[:, :0], pieces).collect()} == {"und"}


def test_langid_held_out_accuracy(spark):
    got = queries.QUERIES["op1_langid"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").where("lang is not null"), "doc_id")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.97


def test_mixing_weights_and_whole_epochs(docs):
    got = mixing.mix(docs, max_repeat=None, entropy=math.log(2) - 1e-6)
    rows = got.collect()
    seen = Counter(r.doc_id for r in rows)
    assert set(seen) == set(range(len(ROWS)))  # every row of every source at least once
    spent, budget = Counter(), {}
    for r in rows:
        spent[r.source] += r._tokens
        budget[r.source] = r._budget
    assert all(spent[s] <= budget[s] for s in spent) and all(abs(r._weight - 0.5) < 0.01 for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_exponent_is_least_within_limit(spark):
    shares = [0.7, 0.2, 0.1]
    df = spark.createDataFrame([(s, int(s * 1000)) for s in shares], "share double, tokens long")
    a = mixing.temperature(df, max_repeat=2.0)
    ratio = lambda x: max(s ** (x - 1) for s in shares) / min(s ** (x - 1) for s in shares)
    assert ratio(a) <= 2.0 and ratio(a - 1e-4) > 2.0


def test_toxicity_separates_planted_words(spark, docs):
    bad = ["vilewordone", "nastytermtwo", "hatefulthree"]
    plain = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(3, 9))) for _ in range(400)]
    rows = [(" ".join(RNG.choice(plain) for _ in range(60)) + (f" {bad[i % 3]} {bad[(i + 1) % 3]} and more" if i % 2 else ""), i % 2) for i in range(300)]
    model = toxicity.fit(rows)
    asked = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r._score >= 0.5 for r in toxicity.score(asked, model).collect()}
    assert sum(got[i] == bool(y) for i, (_, y) in enumerate(rows)) > 290
    scored = toxicity.score(docs, model)
    assert scored.count() == len(ROWS) and scored.where("_score is null or _score < 0 or _score > 1").count() == 0
    assert toxicity.score(docs, None).where("_score = 0").count() == len(ROWS)
    assert toxicity.fit([("a", 1)]) is None


def test_toxicity_finds_short_words():
    rnd = random.Random(23)
    bad = ["scum", "oaf", "trash", "idiot", "loser", "ugly"]
    plain = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(400)]

    def some(n):
        for i in range(n):
            words = [rnd.choice(plain) for _ in range(60)]
            if i % 2:
                words[rnd.randrange(60)] = rnd.choice(bad)
            yield " ".join(words), i % 2

    model = toxicity.fit(list(some(600)))
    meter = toxicity.Meter(model.ordinary, model.toxic)
    held = [(sum(a * b for a, b in zip(model.weights, (1.0, *meter.features(t)))) >= 0, y) for t, y in some(400)]
    assert sum(p for p, y in held if y) > 180 and sum(p for p, y in held if not y) < 20


def test_repeats_match_brute_force(docs):
    seen, told = {}, {}
    for i, t, *_ in ROWS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        grams = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, g in enumerate(grams):
            if seen.get(g, i) < i:
                gone[k : k + 50] = b"\1" * 50
        for g in grams:
            seen.setdefault(g, i)
        rest = bytes(x for x, m in zip(b, gone) if not m)
        told[i] = (len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), hashlib.sha256(rest).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.remove_repeats(docs, block_bytes=2000).collect()}
    assert got == told
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a b", "<p>" + "é\r\n" * 20_000), (2, None, None), (3, "", ""), (4, "http://x", "same"), (5, "http://y", "same"), (5, "http://y", "same"), (6, "u", "WARC/1.1\r\n\r\n0\r\n\r\n")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w", segment=5000)
    got = [(r.page_id, None if r.payload is None else bytes(r.payload), r.record_type, r.refers_to) for r in warc.reassemble(warc.read_records(spark, f"{tmp_path}/w")).collect()]
    told = [(i, (h or "").encode() if i not in (2, 4) else None, "revisit" if i in (2, 4) else "response", {2: 3, 4: 5}.get(i)) for i, _, h in rows]
    assert sorted(got, key=str) == sorted(told, key=str)
    with pytest.raises(ValueError):
        warc.unchunk(b"3\r\nabcd\r\n0\r\n\r\n")


def brute_fingerprint(t):
    w = lower_words(t)
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    c = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(i):
                if linked(i, j):
                    c[i] = c[j] = min(c[i], c[j])
    return c


def test_simhash_matches_brute_force(spark, docs):
    rnd = random.Random(5)
    base = " ".join(rnd.choice(VOCAB) for _ in range(300)).split()
    texts = TEXTS + [" ".join(base[:k] + [rnd.choice(VOCAB)] + base[k + 1 :]) for k in range(0, 300, 6)]
    prints = [brute_fingerprint(t) for t in texts]
    told = components(len(texts), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fp.hex(), r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{p:016x}", told[i]) for i, p in enumerate(prints)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_shards_lose_no_pair(spark):
    rnd = random.Random(7)
    prints = [rnd.getrandbits(64) for _ in range(300)]
    prints += [p ^ sum(1 << b for b in rnd.sample(range(64), 3)) for p in prints]
    df = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")), i) for i, p in enumerate(prints)], "fp binary, node long")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(df, shard_rows=40).collect()}
    assert {(i, i + 300) for i in range(300)} <= got


def test_similar_documents_keep_one_of_each_class(spark, docs):
    rnd = random.Random(9)
    base = [" ".join(rnd.choice(VOCAB) + str(rnd.randrange(99)) for _ in range(400)).split() for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:200], "new", *b[201:]]) for b in base] + [" ".join([*b[:200], *base[0][:200]]) for b in base[1:]]
    kept = simhash.drop_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, *range(12, 17)]
    again = simhash.drop_similar(docs.unionAll(docs))
    assert again.columns == docs.columns and sorted(r.doc_id for r in again.collect()) == [0, 2, 3, 6, 7, 9]
    assert simhash.drop_similar(docs.limit(0)).count() == 0


def test_similar_documents_match_brute_force_jaccard(spark):
    rnd = random.Random(17)
    texts = []
    for n, copies, tops in ((8, 60, 2), (12, 40, 2), (300, 30, 16), (600, 15, 30)):
        for _ in range(copies):
            base = [f"t{rnd.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(2):
                edits = rnd.randrange(tops)
                other = list(base)
                for k in rnd.sample(range(n), edits):
                    other[k] = f"t{rnd.randrange(10**6)}"
                texts.append(" ".join([*other, "end"] if rnd.random() < 0.5 else other[:-1]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = {(i, j) for i in range(len(sets)) for j in range(max(0, i - 2), i) if i // 3 == j // 3 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    parent = list(range(len(texts)))
    for _ in range(3):
        for i, j in sorted(near):
            parent[i] = parent[j] = min(parent[i], parent[j])
    kept = simhash.drop_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, p in enumerate(parent) if p == i}


def test_similar_documents_try_what_a_refused_pair_hid(spark, monkeypatch):
    rnd = random.Random(19)
    base = [f"t{rnd.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(30):  # all near to the first, not to each other
        k = rnd.randrange(50, 350)
        texts.append(" ".join([*base[:k], *(f"t{rnd.randrange(10**6)}" for _ in range(30)), *base[k + 30 :]]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    comp = components(len(texts), lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tried in (64, 0):
        monkeypatch.setattr(simhash, "TRIED", tried)
        assert {r.doc_id for r in simhash.drop_similar(df).collect()} == {i for i, c in enumerate(comp) if c == i}


def test_a_group_below_the_similarity_has_few_candidates(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(60):
        words = list(base)
        for i in rng.sample(range(400), 9):  # pairs have a similarity of about 0.65
            words[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = simhash.wide_fingerprints(df).select("fp", "node")
    assert simhash.candidates(nodes, 0.8).count() <= len(texts)
    assert simhash.drop_similar(df).count() == len(texts)


def test_similar_documents_with_null_and_repeated_ids(spark):
    rnd = random.Random(13)
    texts = [" ".join(rnd.choice(VOCAB) + str(rnd.randrange(99)) for _ in range(200)) for _ in range(8)]
    rows = [(None, t) for t in texts[:3]] + [(7, t) for t in texts[3:6]] + [(8, texts[6]), (9, texts[7])]
    rows += [(10, texts[0] + " more"), (11, texts[1] + " more"), (7, texts[3]), (None, texts[2])]
    kept = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([rows[2], *rows[3:10]], key=str)


def test_embeddings_match_brute_force(spark):
    import numpy as np

    g = np.random.default_rng(1)
    v = np.concatenate([g.normal(size=(80, 8)), g.normal(size=(4, 8)).repeat(20, 0) + g.normal(size=(80, 8)) * 0.25]).tolist()
    v += [v[0], [0.0] * 8, None, [None] * 8, [float("nan")] * 8, []]
    ok = [x is not None and len(x) > 0 and all(y is not None and math.isfinite(y) for y in x) and any(x) for x in v]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    near = lambda i, j: ok[i] and ok[j] and cos(v[i], v[j]) >= 0.9
    comp = components(len(v), near)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.near_vectors(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"), interval=16).collect()}
    assert got == {i: (sum(near(i, j) for j in range(len(v)) if j != i), comp[i], comp[i] == i) for i in range(len(v))}
    assert embed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def brute_hits(words, items):
    hit, names = set(), set()
    for name, w in items:
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    names.add(name)
    return hit, names


def test_decontamination_matches_brute_force(spark, docs):
    items = [("a", LONG[50:200]), ("b", "w1 W2"), ("c", None), ("d", ""), ("e", LONG[50:200]), ("f", LONG[600:800])]
    df = spark.createDataFrame(items, "item_id string, text string")
    parsed = [(i, decontam.words_of(t)) for i, t in items if t]
    for limit in (10**6, 40):
        decontam.CHUNK_WORDS, was = limit, decontam.CHUNK_WORDS
        found = decontam.chunks.__defaults__
        decontam.chunks.__defaults__ = (limit,)
        try:
            got = {r.doc_id: (r.n_words, r.n, sorted(r["items"])) for r in decontam.contamination(docs, df).withColumn("n", decontam.hit_words()).collect()}
        finally:
            decontam.CHUNK_WORDS, decontam.chunks.__defaults__ = was, found
        for i, t, *_ in ROWS:
            words = decontam.words_of(t)
            hit, names = brute_hits(words, parsed)
            assert got[i] == (len(words), len(hit), sorted(names)), i
    kept = decontam.decontaminate(docs, df)
    bad = {i for i, t, *_ in ROWS if (h := brute_hits(decontam.words_of(t), parsed)[0]) and 20 * len(h) >= len(decontam.words_of(t))}
    assert bad and {r.doc_id for r in kept.collect()} == set(range(len(ROWS))) - bad and kept.columns == docs.columns
    assert decontam.decontaminate(docs, df.limit(0)).count() == len(ROWS)
    cut = decontam.decontaminate(docs, df, action="cut")
    assert cut.count() == len(ROWS) and cut.columns == docs.columns


def test_suffix_tree_base_is_exact_and_model_beats_it(spark, docs):
    rnd = random.Random(2)
    pairs = [("alpha", "beta"), ("gamma", "delta"), ("one", "two")]
    texts = [" ".join(" ".join(rnd.choice(pairs)) for _ in range(50)) for _ in range(60)] + [None, "", "Unseen words"]
    df = spark.createDataFrame([(i, t, i % 5 != 0) for i, t in enumerate(texts)], "doc_id long, text string, tr boolean")
    got = {r.doc_id: r for r in pst.score_texts(df, "tr").collect()}
    c = Counter(w for i, t in enumerate(texts) if i % 5 for w in pst.normal(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w, r = pst.normal(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    assert sum(got[i].score for i in range(0, 60, 5)) > 0.7 * sum(got[i].base_score for i in range(0, 60, 5))
    none = pst.score_texts(docs.withColumn("tr", F.lit(False)), "tr").collect()
    assert len(none) == len(ROWS) and {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0}
    assert pst.score_texts(docs.withColumn("tr", F.lit(True)).limit(0), "tr").count() == 0


def test_sharding_matches_prefix_sums(docs):
    both = docs.unionAll(docs).unionAll(docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars", "shard"))
    got = sharding.shard_by_bytes(both, n_shards=4, bucket_rows=5, keep=both.columns)
    rows = got.collect()
    assert len(rows) == 3 * len(ROWS) and got.columns.count("shard") == 1
    whole, upto = sum(r.size for r in rows), 0
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        assert r.shard == min((2 * upto + r.size) * 4 // (2 * whole), 3)
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        upto += r.size
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_pipeline_against_its_operators(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id for r in cp.run(spark, SF).collect()}
    toxic = {r.doc_id for r in docs.join(cp.drop_toxic(spark, docs, SF), "doc_id", "left_anti").collect()}
    left = {i: t for i, t in left.items() if i not in toxic}
    left = {i: left[i] for i in least_of_similar(left)}
    items = [(r.item_id, decontam.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for i, t in left.items():
        w = decontam.words_of(t)
        hit, _ = brute_hits(w, [x for x in items if set(x[1][:1]) | set(x[1]) & set(w)]) if len(w) < 600 else (None, None)
        if hit is None:
            hit = {k for a, b in decontam.Automaton([(str(n), x) for n, x in items]).hits(w)[0] for k in range(a, b)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    assert out == clean


def least_of_similar(texts):
    """Ids that are the least of their class; texts with a Jaccard similarity of 0.8 or more of their five-word shingles link."""
    words, ids = {i: lower_words(t) for i, t in texts.items()}, sorted(texts)
    sets = [{tuple(words[i][k : k + 5]) for k in range(max(1, len(words[i]) - 4))} if words[i] else set() for i in ids]
    comp = components(len(ids), lambda a, b: sets[a] == sets[b] or bool(sets[a] & sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    return {i for k, i in enumerate(ids) if comp[k] == k}


def test_pipeline_near_duplicates_match_brute_force_jaccard(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()} == least_of_similar({r.doc_id: r.text for r in docs.collect()})


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(1, None), (None, "null id here"), (2, ""), (2, ""), (3, LONG), (4, LONG + " more"), (5, "Ünïcode \n"), (None, None), (6, "a b c d e f g h i j k l m n")]
    df = spark.createDataFrame([(i, t, "en", None, 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, size int, _score int, shard int")
    items = spark.createDataFrame([("x", "a b c d e f g h i j k l m"), (None, None)], "item_id string, text string")
    labels = spark.createDataFrame([(1, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    for name, made in (("full", df), ("none", df.limit(0))):
        for table, part in (("documents", made), ("benchmark", items), ("labels", labels)):
            part.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    got = [(r.doc_id, r.text) for r in cp.run(spark, f"{tmp_path}/full").collect()]
    assert {i for i, _ in got} == {1, None, 3, 5}  # texts without words are alike; rows without an id stay
    assert (6, rows[-1][1]) not in got and (4, LONG + " more") not in got and (None, "null id here") in got
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
