"""Balance, plans, clashing columns and brute-force rules of the corpus operators."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import decontam, mixing, sharding, simhash, substring, toxicity, warc


def test_vantage_points_divide_random_keys_evenly():
    keys = np.random.default_rng(5).integers(0, 2**32, 1 << 18, dtype=np.uint32)
    tree = simhash.build_tree(keys[: 1 << 16], 16)
    rows, shard, home = simhash.shards_of(keys, tree)
    held = np.bincount(shard[home], minlength=tree.shards)
    assert tree.shards > 4096 and held.sum() == len(keys) and held.max() < 4 * held.mean()
    assert len(rows) / len(keys) < 1.3 ** np.log2(tree.shards)
    same = simhash.build_tree(np.full(1000, 7, np.uint32), 16)
    assert same.shards == 1 and len(simhash.shards_of(keys[:10], same)[0]) == 10


def test_keys_of_repeats_fill_buckets_evenly():
    rnd = np.random.default_rng(6)
    data = rnd.integers(97, 123, 400_000).astype(np.uint8)
    key = np.unique(substring.mixed(substring.keys_of(data)))
    held = np.bincount((key >> np.uint64(57)).astype(np.int64), minlength=128)
    assert held.max() < 2 * held.mean()


def test_repeats_of_long_texts_null_ids_and_repeated_rows(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(substring, "PART_BYTES", 500)
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = [(3, base), (1, base[100:900]), (None, "x" + base[2000:2400]), (5, base[1000:1300] + "é" * 60), (5, base[1000:1300] + "é" * 60)]
    got = sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=1000).collect()), key=str)
    told, seen = [], {}
    for i, t in rows:
        b, k = t.encode(), 1 << 62 if i is None else i
        for j in range(len(b) - 49):
            seen[b[j : j + 50]] = min(k, seen.get(b[j : j + 50], k))
    for i, t in rows:
        b, k = t.encode(), 1 << 62 if i is None else i
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if seen[b[j : j + 50]] < k:
                gone[j : j + 50] = b"\1" * 50
        rest = bytes(x for x, m in zip(b, gone) if not m)
        told.append((i, sum(gone), hashlib.sha256(rest).hexdigest()))
    assert got == sorted(told, key=str)


def test_mixing_matches_a_plain_permutation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    rnd = random.Random(9)
    rows = [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 12))), None if i % 11 == 0 else f"s{min(i % 7, 2)}", 1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _weight int, _tokens int")
    got = mixing.mix(df, max_repeat=1.7)
    assert got.columns == ["doc_id", "text", "source", "_weight_in", "_tokens_in", *mixing.ADDED]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan
    key = F.xxhash64(F.lit(0), "doc_id", "text")
    out = got.collect()
    spent = Counter((r.source, r.doc_id, r._epoch) for r in out)
    budget = {r.source: r._budget for r in out}
    turn = F.xxhash64(F.lit(0), F.lit("block"), "source", "b", "e")
    for s in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == s]
        size = {r[0]: len((r[1] or "").split()) + 1 for r in own}
        total, blocks = sum(size.values()), -(-len(own) // 3)
        full, left = divmod(budget[s], total)
        told = Counter((s, r[0], e) for r in own for e in range(full))
        cells = {r.doc_id: r.cell for r in df.where(F.col("source").eqNullSafe(s)).select("doc_id", F.pmod(key, F.lit(mixing.CELLS)).alias("cell")).collect()}
        by = defaultdict(list)
        for r in own:
            by[cells[r[0]] * blocks // mixing.CELLS].append(r)
        order = {r.b: r.t for r in spark.createDataFrame([(s, b, full) for b in by], "source string, b int, e int").select("b", turn.alias("t")).collect()}
        inside = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(0), F.lit(full).cast("int"), "doc_id", "text").alias("h")).collect()}
        used = 0
        for b in sorted(by, key=lambda b: (order[b], b)):
            whole = sum(size[r[0]] for r in by[b])
            if used + whole <= left:
                told.update((s, r[0], full) for r in by[b])
                used += whole
                continue
            for r in sorted(by[b], key=lambda r: (inside[r[0]], r[0])):
                if used + size[r[0]] > left:
                    break
                used += size[r[0]]
                told[s, r[0], full] += 1
            break
        assert {k: n for k, n in spent.items() if k[0] == s} == told
    assert mixing.mix(df, marks=False).columns == df.columns


def test_mixing_keeps_the_limit_under_a_budget(spark):
    rows = [(i, "a b c", "big" if i % 10 else "small") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, budget=600, max_repeat=2.0).groupBy("source").agg(F.sum("_tokens").alias("n")).collect()
    whole = {"big": 360, "small": 40}
    assert all(r.n <= 2 * whole[r.source] for r in got)


def test_columns_of_any_name_stay(spark):
    rows = [(1, "one two three", 1.0, 2, 3, 4, 5), (None, None, 1.0, 2, 3, 4, 5), (2, "", 1.0, 2, 3, 4, 5), (2, "", 1.0, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _score double, _found int, _hit int, _tid int, size int")
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    scored = toxicity.score(df, None, "__score")
    assert scored.columns == [*df.columns, "__score"] and scored.count() == 4
    for action, n in (("drop", 3), ("cut", 4)):
        got = decontam.decontaminate(df, items, action=action)
        assert got.columns == df.columns and got.count() == n
    assert sorted(map(str, simhash.drop_similar(df).columns)) == sorted(df.columns)
    sharded = sharding.shard_by_bytes(df, keep=df.columns)
    assert "size_in" in sharded.columns and {r.size_in for r in sharded.collect()} == {5}


def test_archives_of_other_writers_are_read(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(body), body)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record))
    (got,) = warc.reassemble(warc.read_records(spark, str(tmp_path))).collect()
    assert (got.page_id, bytes(got.payload), got.payload_bytes, got.payload_digest) == (None, b"<p>hi</p>", 9, warc.digest32(b"<p>hi</p>"))
    assert warc.reassemble(warc.read_records(spark, str(tmp_path)).limit(0)).count() == 0
