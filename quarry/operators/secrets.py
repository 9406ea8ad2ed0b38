"""Credential-like assignments in source text: where they stand, how random they are, and a keyed fingerprint in place of their value."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.views import table

#: Name, sign and value of an assignment whose name speaks of a credential; values of eight characters or more.
ASSIGNMENT = r"""(?i)([a-z0-9_.-]*(?:password|passwd|secret|token|api_?key|credential)[a-z0-9_]*)["']?[ \t]*(?::=|=>|=|:)[ \t]*["']?([a-z0-9+/=_.~!@#$%^&*-]{8,})"""
#: Bits a character from which a value counts as random.
RANDOM_BITS = 3.5


def entropy(value: Column) -> Column:
    """Shannon entropy of a text's characters, in bits a character; 0 for an empty text, null for null.

    Row-local: each distinct character is counted by what its removal takes from the length.
    """
    n = F.length(value).cast("double")
    times = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double")
    chars = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")
    bits = F.aggregate(chars, F.lit(0.0), lambda s, c: s - times(c) / n * F.log2(times(c) / n))
    return F.when(value == "", F.lit(0.0)).otherwise(bits)


def shape(value: Column) -> Column:
    """What may be shown of a value: its length and the kinds of its characters, as `[redacted:12] a0#`."""
    kinds = [F.when(value.rlike(p), F.lit(k)).otherwise(F.lit("")) for p, k in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), ("[^A-Za-z0-9]", "#"))]
    return F.concat(F.lit("[redacted:"), F.length(value).cast("string"), F.lit("] "), *kinds)


def keyed(key: bytes, value: Column, prefix: str = "hmac-sha256:") -> Column:
    """HMAC-SHA256 of a text's UTF-8 under a key, in lowercase hex; null for null.

    The key travels in the pickled function, not as a literal, so that no plan, log or event shows it.
    """

    @F.pandas_udf("string")
    def sealed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: None if v is None else prefix + hmac.new(key, v.encode(), hashlib.sha256).hexdigest()).astype(object)

    return sealed(value)


def credential_candidates(df: DataFrame, place: str, text: str, key: bytes, least: float = RANDOM_BITS) -> DataFrame:
    """(place, line, name, length, entropy, random, shape, fingerprint): credential assignments of a table's texts.

    Lines count from 1 and end at line feeds; a line may hold several assignments. Null and empty
    texts hold none. One place, name and value is given once, at its first line. Values leave no
    task: what is shuffled and returned is the fingerprint. Other columns are not kept.
    """
    lines = df.select(F.col(place).alias("place"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "t")).where(F.col("t").rlike(ASSIGNMENT))
    each = F.arrays_zip(F.regexp_extract_all("t", F.lit(ASSIGNMENT), 1).alias("name"), F.regexp_extract_all("t", F.lit(ASSIGNMENT), 2).alias("value"))
    found = lines.select("place", (F.col("line") + 1).cast("long").alias("line"), F.explode(each).alias("a")).select("place", "line", "a.name", "a.value")
    value = F.col("value")
    told = found.select("place", "name", "line", F.length(value).cast("long").alias("length"), F.round(entropy(value), 6).alias("entropy"), shape(value).alias("shape"), keyed(key, value).alias("fingerprint"))
    once = told.groupBy("place", "name", "fingerprint").agg(F.min("line").alias("line"), *[F.first(c).alias(c) for c in ("length", "entropy", "shape")])
    return once.select("place", "line", "name", "length", "entropy", (F.col("entropy") >= least).alias("random"), "shape", "fingerprint")


#: The key of the query, so that SQL can tell the same fingerprints; a real one is random and kept apart.
QUERY_KEY = b"key of the query, no secret"


def _configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents after which settings follow, some of them secrets, some repeated."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    settings = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('\nservice.api_key = "'), digest, F.lit('"\nuser = "someone"'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\nPASSWORD: aaaaaaaabbbb, db_token=>"), F.substring(digest, 1, 9), F.lit("\nPASSWORD: aaaaaaaabbbb"))).otherwise("\npassword = short")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), settings).alias("text"))


def credential_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential assignments of all documents with settings behind them."""
    found = credential_candidates(_configured(spark, sf_dir), "doc_id", "text", QUERY_KEY)
    return found.withColumnRenamed("place", "doc_id")


_PAD = [bytes(b ^ x for b in QUERY_KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
_RE = ASSIGNMENT.replace("'", "''")
QUERIES = {f.__name__: f for f in (credential_lines,)}
ORACLES = {
    "credential_lines": f"""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'service.api_key = "' || md5(coalesce(text, '')) || '"' || chr(10) || 'user = "someone"' WHEN 1 THEN chr(10) || 'PASSWORD: aaaaaaaabbbb, db_token=>' || left(md5(coalesce(text, '')), 9) || chr(10) || 'PASSWORD: aaaaaaaabbbb' ELSE chr(10) || 'password = short' END AS text FROM documents
      ), s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM d), l AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS t FROM s
      ), a AS (SELECT doc_id, line, unnest(regexp_extract_all(t, '{_RE}', 1)) AS name, unnest(regexp_extract_all(t, '{_RE}', 2)) AS value FROM l WHERE regexp_matches(t, '{_RE}')
      ), f AS (SELECT doc_id, name, value, min(line) AS line FROM a GROUP BY ALL
      ), c AS (SELECT value, c, count(*) AS n FROM (SELECT value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM f)) WHERE c <> '' GROUP BY ALL
      ), e AS (SELECT value, round(-sum(n / length(value) * log2(n / length(value))), 6) AS entropy FROM c GROUP BY value)
      SELECT doc_id, line, name, length(value) AS length, entropy, entropy >= {RANDOM_BITS} AS random,
        '[redacted:' || length(value) || '] ' || CASE WHEN regexp_matches(value, '[a-z]') THEN 'a' ELSE '' END || CASE WHEN regexp_matches(value, '[A-Z]') THEN 'A' ELSE '' END || CASE WHEN regexp_matches(value, '[0-9]') THEN '0' ELSE '' END || CASE WHEN regexp_matches(value, '[^A-Za-z0-9]') THEN '#' ELSE '' END AS shape,
        'hmac-sha256:' || sha256(unhex('{_PAD[1]}') || unhex(sha256(unhex('{_PAD[0]}') || encode(value)))) AS fingerprint FROM f JOIN e USING (value)""",
}
