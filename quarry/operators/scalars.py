"""Queries over the column functions: identities, paths, text measures, dates and money."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.secrets import entropy
from quarry.plans.views import table


def slug_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, T.slug(F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_slug(name).alias("is_slug"))


def nonblank_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("doc_id") % 4 == 0, F.lit("   ")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").where(T.nonblank(note)).select("doc_id", note.alias("note"))


def workspace_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.workspace_id(F.concat(F.lit("/work/"), F.col("s_name"))).alias("target_id"))


def repository_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_brand", F.lit("/"), F.expr("repeat(p_name, CAST(p_partkey % 15 AS INT))"))
    return table(spark, sf_dir, "part").select("p_partkey", T.repository_id(name).alias("repository_id"))


def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each part as compact JSON whose keys are in order; nulls leave their key out."""
    doc = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size")))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(doc, 256).alias("digest"))


def folder_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest a brand and type over its files in the order of their paths, each with its lengths; a folder's entries meet in one group."""
    entry = F.concat_ws(":", F.length("path").cast("string"), "path", F.octet_length("p_name").cast("string"), "p_name")
    files = table(spark, sf_dir, "part").withColumn("path", F.concat_ws("/", "p_brand", "p_type", "p_partkey"))
    found = files.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))).alias("l"))
    return found.select("p_brand", "p_type", F.sha2(F.array_join(F.transform("l", lambda x: x["e"]), "\n"), 256).alias("digest"))


def cwe_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.upper(F.trim(F.concat(F.lit(" cwe-"), F.col("p_size"), F.lit(" ")))).alias("cwe"))


def path_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths written in many ways; those that are not below their root are null."""
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, F.concat_ws("\\", "p_brand", "p_type")).when(k == 1, F.concat(F.lit("/"), "p_brand")).when(k == 2, F.concat(F.lit("C:/"), "p_brand"))
    raw = raw.when(k == 3, F.concat("p_brand", F.lit("/../x"))).when(k == 4, F.concat(F.lit("./"), "p_brand", F.lit("/./"), "p_type")).otherwise(F.concat("p_brand", F.lit("//"), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.relative_path(raw).alias("path"))


def git_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("s_suppkey") % 5, F.replace(F.lower("s_name"), F.lit("#"), F.lit("-"))
    raw = F.when(k == 0, F.concat(F.lit("https://user@Host.example:443/org/"), name, F.lit(".git"))).when(k == 1, F.concat(F.lit("git@Host.example:org/"), name, F.lit(".git")))
    raw = raw.when(k == 2, F.concat(F.lit("ssh://git@host.example:2222/org/"), name)).when(k == 3, F.concat(F.lit("ftp://host.example/"), name)).otherwise(F.concat(F.lit("https://host.example/org/"), name, F.lit("?x=1")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.git_origin(raw).alias("o")).select("s_suppkey", "o.host", "o.path")


def decoded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    uri = F.when(k == 0, F.concat(F.lit("file:///srv/"), "p_brand", F.lit("/a%20b+c?x#y"))).when(k == 1, F.concat(F.lit("https://h.example/d/"), "p_brand", F.lit("#f"))).otherwise(F.concat("p_type", F.lit("/%41")))
    uri = F.replace(uri, F.lit("Brand#"), F.lit("Brand%23"))
    return table(spark, sf_dir, "part").select("p_partkey", T.decoded_path(uri, "/srv").alias("path"))


def byte_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.byte_prefix(F.coalesce("text", F.lit("")), 40).alias("prefix"))


def line_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (F.col("doc_id") % 12 + 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.excerpt(F.coalesce("text", F.lit("")), first, first + 2)).alias("excerpt"))


def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.compact(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "x"))).cast("long").alias("n"))


def fitted_lines(spark: SparkSession, sf_dir: str, budget: int = 2000) -> DataFrame:
    """The largest limit a line, of 4096 bytes at most, at which a text's cut lines fit the budget; found by halving."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.octet_length).alias("w"))
    size = lambda most: F.aggregate("w", F.lit(0), lambda a, x: a + F.least(x, most) + 1) - 1
    found = F.lit(0)
    for step in (4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1):
        docs = docs.withColumn("at", found if step == 4096 else F.col("at"))
        docs = docs.withColumn("at", F.when((F.col("at") + step <= 4096) & (size(F.col("at") + step) <= budget), F.col("at") + step).otherwise(F.col("at")))
    return docs.select("doc_id", F.col("at").cast("long").alias("width"))


def json_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.explode(F.json_object_keys("props")).alias("key")
    return table(spark, sf_dir, "events").select("event_type", keys).groupBy("event_type", "key").agg(F.count("*").alias("n"))


def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit("\0"), "p_type")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", content.contains("\0").alias("is_binary"))


def clean_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("\x1b[31m"), "p_name", F.lit("\x1b[0m\x07\t"), "p_type", F.lit("\x00"))
    return table(spark, sf_dir, "part").select("p_partkey", T.without_control(raw).alias("shown"))


def title_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`title [id]` in two, where the id is a known one."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" ["), F.col("p_partkey") * 2, F.lit("]")).alias("t"))
    part = part.withColumn("title", F.regexp_extract("t", r"^(.*) \[([^\[\]]+)\]$", 1)).withColumn("id", F.regexp_extract("t", r"^(.*) \[([^\[\]]+)\]$", 2).cast("long"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    both = part.join(known, F.col("id") == F.col("k"), "left")
    return both.select("p_partkey", F.when(F.col("k").isNull(), F.col("t")).otherwise(F.col("title")).alias("title"), F.col("k").alias("annotation"))


def code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.expr("repeat('`', CAST(p_partkey % 6 AS INT))"), "p_type", F.lit("``"))
    return table(spark, sf_dir, "part").select("p_partkey", T.fence(text).alias("fence"))


def valid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k == 0, F.concat(day, F.lit("T10:20:30Z"))).when(k == 1, F.concat(F.substring(day, 1, 8), F.lit("31T00:00:00+02:00"))).when(k == 2, F.concat(day, F.lit(" 10:00:00Z"))).otherwise(F.concat(day, F.lit("T24:00:00Z")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.is_rfc3339(raw).alias("valid"))


def sorted_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct locations of each order: by role, path and line; A is the root control, then N, then R."""
    rank = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag"))
    one = F.struct(rank.alias("r"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("role"))
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(one)).alias("l"))
    return found.select("l_orderkey", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["path"], x["line"], x["role"])), ",").alias("locations"))


def name_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy, in bits, of the characters of each part's name; the names of a repeated part count together, an empty one has 0."""
    names = table(spark, sf_dir, "part").where("p_name IS NOT NULL").select("p_partkey", "p_name").repartition("p_partkey")
    whole = names.groupBy("p_partkey").agg(F.array_join(F.collect_list("p_name"), "").alias("name"))
    return whole.select("p_partkey", F.round(entropy(F.col("name")), 6).alias("entropy"))


def usd_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nano = (F.round(F.col("o_totalprice") * 100).cast("long") * 1000 + F.col("o_orderkey") % 10) * F.when(F.col("o_orderkey") % 9 == 0, -10_000).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.dollars(nano).alias("usd"))


QUERIES = {f.__name__: f for f in (slug_check, nonblank_notes, workspace_ids, repository_ids, canonical_digest, folder_digest, cwe_normalized, path_normalized, git_origins, decoded_paths, byte_prefixes, line_excerpt, compact_text, fitted_lines, json_outline, binary_files, clean_control, title_annotations, code_fences, valid_dates, sorted_locations, name_entropy, usd_amounts)}
ORACLES = {
    "slug_check": "SELECT p_partkey, regexp_full_match(CASE WHEN p_partkey % 3 = 0 THEN regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9._/-]+', '-', 'g'), '^[._/-]+|[._/-]+$', '', 'g') ELSE p_name END, '[a-z0-9][a-z0-9._/-]*') AS is_slug FROM part",
    "nonblank_notes": "SELECT doc_id, source AS note FROM documents WHERE doc_id % 4 <> 0 AND trim(source) <> ''",
    "workspace_ids": "SELECT s_suppkey, sha256('local-workspace' || chr(0) || '/work/' || s_name) AS target_id FROM supplier",
    "repository_ids": "WITH n AS (SELECT p_partkey, p_brand || '/' || repeat(p_name, p_partkey % 15) AS n FROM part) SELECT p_partkey, CASE WHEN length(replace(n, '/', '--')) > 128 THEN replace(n, '/', '--')[1:111] || '-' || sha256(n)[1:16] ELSE replace(n, '/', '--') END AS repository_id FROM n",
    "canonical_digest": """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '"' || CASE WHEN p_size > 10 THEN ',"size":' || p_size ELSE '' END || '}') AS digest FROM part""",
    "folder_digest": "WITH f AS (SELECT p_brand, p_type, p_name, p_brand || '/' || p_type || '/' || p_partkey AS path FROM part) SELECT p_brand, p_type, sha256(string_agg(length(path) || ':' || path || ':' || strlen(p_name) || ':' || p_name, chr(10) ORDER BY path)) AS digest FROM f GROUP BY 1, 2",
    "cwe_normalized": "SELECT p_partkey, upper(trim(' cwe-' || p_size || ' ')) AS cwe FROM part",
    "path_normalized": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand || '/' || p_type WHEN 4 THEN p_brand || '/' || p_type WHEN 5 THEN p_brand || '/' || p_type END AS path FROM part",
    "git_origins": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 IN (0, 1) THEN 'host.example' WHEN s_suppkey % 5 = 2 THEN 'host.example:2222' END AS host, CASE WHEN s_suppkey % 5 < 3 THEN 'org/' || replace(lower(s_name), '#', '-') END AS path FROM supplier",
    "decoded_paths": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '/a b+c' WHEN 1 THEN NULL ELSE p_type || '/A' END AS path FROM part",
    "byte_prefixes": "SELECT doc_id, left(t, CAST((SELECT max(k) FROM range(0, 41) r(k) WHERE strlen(left(t, CAST(k AS INT))) <= 40) AS INT)) AS prefix FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "line_excerpt": """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, CAST(doc_id % 12 + 1 AS INT) AS f FROM documents), r AS (SELECT doc_id, l, greatest(f - 1, 1) AS lo, least(f + 3, len(l)) AS hi FROM d)
      SELECT doc_id, md5(CASE WHEN lo <= hi THEN array_to_string(list_transform(range(lo, hi + 1), lambda i: lpad(CAST(i AS VARCHAR), CAST(length(CAST(hi AS VARCHAR)) AS INT), ' ') || ': ' || l[i]), chr(10)) ELSE '' END) AS excerpt FROM r""",
    "compact_text": r"SELECT doc_id, length(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS n FROM documents",
    "fitted_lines": """WITH w AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: strlen(x)) AS w FROM documents), c AS (SELECT doc_id, list_distinct(list_concat([0, 4096], w)) AS c, w FROM w)
      SELECT doc_id, CASE WHEN len(w) - 1 > 2000 THEN 0 WHEN list_sum(list_transform(w, lambda x: least(x, 4096))) + len(w) - 1 <= 2000 THEN 4096
        ELSE (SELECT max(k) FROM range(0, 4097) r(k) WHERE list_sum(list_transform(w, lambda x: least(x, k))) + len(w) - 1 <= 2000) END AS width FROM c""",
    "json_outline": "SELECT event_type, unnest(json_keys(props)) AS key, count(*) AS n FROM events GROUP BY 1, 2",
    "binary_files": "SELECT p_partkey, p_partkey % 7 = 0 AS is_binary FROM part",
    "clean_control": "SELECT p_partkey, p_name || chr(9) || p_type AS shown FROM part",
    "title_annotations": "SELECT p.p_partkey, CASE WHEN k.p_partkey IS NULL THEN p.p_name || ' [' || p.p_partkey * 2 || ']' ELSE p.p_name END AS title, k.p_partkey AS annotation FROM part p LEFT JOIN part k ON k.p_partkey = p.p_partkey * 2",
    "code_fences": "SELECT p_partkey, repeat('`', greatest(3, greatest(p_partkey % 6, 2) + 1)) AS fence FROM part",
    "valid_dates": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN month(o_orderdate) IN (1, 3, 5, 7, 8, 10, 12) ELSE false END AS valid FROM orders",
    "sorted_locations": "SELECT l_orderkey, string_agg(l_partkey || ':' || l_linenumber || ':' || l_returnflag, ',' ORDER BY l_returnflag, l_partkey, l_linenumber) AS locations FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1",
    "name_entropy": "WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part), n AS (SELECT p_partkey, c, count(*) AS n FROM c GROUP BY 1, 2) SELECT p_partkey, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM n GROUP BY 1",
    "usd_amounts": """WITH n AS (SELECT o_orderkey, (CAST(round(o_totalprice * 100) AS BIGINT) * 1000 + o_orderkey % 10) * CASE WHEN o_orderkey % 9 = 0 THEN -10000 ELSE 1 END AS n FROM orders), p AS (SELECT o_orderkey, n, lpad(CAST(abs(n) % 1000000000 AS VARCHAR), 9, '0') AS f FROM n)
      SELECT o_orderkey, CASE WHEN n < 0 THEN '-$' ELSE '$' END || CAST(abs(n) // 1000000000 AS VARCHAR) || '.' || f[1:2] || regexp_replace(f[3:9], '0+$', '') AS usd FROM p""",
}
