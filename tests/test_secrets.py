"""Credential assignments: published HMAC vectors, entropies against a count, and no value in what comes out."""

import collections
import hashlib
import hmac
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import secrets

RNG = random.Random(5)
#: Fixed: test cases 1, 2, 6 of RFC 4231 (text data, keys shorter and longer than a block).
RFC_4231 = [
    (b"\x0b" * 20, "Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", "what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 131, "Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
]


@pytest.mark.parametrize(("key", "data", "digest"), RFC_4231)
def test_keyed_digests_are_the_published_ones(spark, key, data, digest):
    df = spark.createDataFrame([(data,), (None,)], "v string")
    assert [r[0] for r in df.select(secrets.keyed(key, F.col("v"), "")).collect()] == [digest, None]


def test_entropy_matches_a_count(spark):
    texts = ["", "a", "aaaa", "ab", "aA0#é日😀", "\\\\..$$", *["".join(RNG.choice("abcdé😀.$") for _ in range(RNG.randint(1, 60))) for _ in range(100)], None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.entropy(F.col("t")).alias("e")).collect()
    for t, e in rows:
        if t is None:
            assert e is None
        else:
            assert e == pytest.approx(-sum(n / len(t) * math.log2(n / len(t)) for n in collections.Counter(t).values()), abs=1e-9)


def test_assignments_are_found_and_values_stay_hidden(spark):
    key, value = b"some key", "q8Zr-0aXw/91Lm+P"
    text = f'x = 1\nAPI_KEY = "{value}"\nconst dbPassword: \'{value}\', n: 3; token=>{value}\n my.secret := {value}\nAPI_KEY={value}\npassword = short\nnothing_here = {value}'
    df = spark.createDataFrame([(1, text, "clash"), (2, "", "x"), (3, None, "x"), (None, f"token={'a' * 9}", "x")], "file long, body string, line string")
    found = secrets.credential_candidates(df, "file", "body", key)
    rows = found.collect()
    seal = lambda v: "hmac-sha256:" + hmac.new(key, v.encode(), hashlib.sha256).hexdigest()
    assert sorted((r.place, r.line, r.name) for r in rows if r.place) == [(1, 2, "API_KEY"), (1, 3, "dbPassword"), (1, 3, "token"), (1, 4, "my.secret")]
    assert {r.fingerprint for r in rows if r.place} == {seal(value)} and all(r.random and r.shape == "[redacted:16] aA0#" and r.length == 16 for r in rows if r.place)
    assert [(r.line, r.random, r.entropy, r.shape) for r in rows if r.place is None] == [(1, False, 0.0, "[redacted:9] a")]
    assert value not in str(rows) and "some key" not in found._jdf.queryExecution().toString()


def test_very_long_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "token=" + "aB" * 500_000)], "i long, t string")
    r = secrets.credential_candidates(df, "i", "t", b"k").first()
    assert (r.length, r.entropy, r.random) == (1_000_000, 1.0, False)
    assert secrets.credential_candidates(df.limit(0), "i", "t", b"k").count() == 0


def test_name_entropy_is_local_and_joins_repeated_parts(spark, tmp_path):
    from oracle import same
    from quarry.operators import scalars

    rows = [(1, "aab"), (1, "bc"), (2, ""), (3, None), (4, "\U0001F600a"), (None, "xy"), (5, "zzzz")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/w")
    (found,) = (tmp_path / "w").glob("part-*.parquet")
    found.rename(tmp_path / "part.parquet")
    same(spark, scalars.name_entropy, scalars.ORACLES["name_entropy"], str(tmp_path))
    assert "Generate" not in scalars.name_entropy(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()  # no row a character
