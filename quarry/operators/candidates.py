"""Candidates, identities, ranking, coverage, snapshots and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import views
from quarry.plans.views import table


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_brand", "concat(p_brand, '/', p_type, '/', p_partkey) AS path", "p_size")


def path_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(T.in_scope(F.col("path"), "./Brand#2/")).select("p_partkey", "path")


def path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(T.glob(F.col("path"), "Brand#1?/*[05]")).select("p_partkey", "path")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = T.fingerprint(F.col("p_brand"), T.slug(F.col("p_name")), F.col("path"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")))
    rows = _paths(spark, sf_dir).select("p_partkey", T.slug(F.col("p_name")).alias("rule"), digest.alias("fingerprint"))
    return rows.withColumn("finding_id", T.stable_id("csf", F.sha2("fingerprint", 256)))


def merge_candidates(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """One row a key: texts are the sorted distinct values of all its candidates, joined by line feeds."""
    merged = rows.groupBy(*keys).agg(*[F.array_join(F.array_sort(F.collect_set(c)), "\n").alias(c) for c in texts], F.count("*").alias("n"))
    digest = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256)
    return merged.withColumn("candidate_id", F.concat(F.lit("candidate-"), F.substring(digest, 1, 16)))


def candidates_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 10 AS rule", "l_partkey AS part", "l_returnflag AS summary", "l_linestatus AS evidence")
    return merge_candidates(rows, ["rule", "part"], ["summary", "evidence"])


def strongest_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest of the reports of one part by one target; the first on a tie."""
    best = F.min(F.struct("sev", "seq", "line", "flag")).alias("k")
    return views.findings(spark, sf_dir).groupBy("target_id", "part").agg(best, F.count("*").alias("reports")).select("target_id", "part", views.severity_name(F.col("k.sev")).alias("severity"), F.col("k.seq").alias("seq"), F.col("k.line").alias("line"), "reports")


def cwe_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see cwe-"), F.col("p_size"), F.lit(", CWE_79 and CWE "), F.col("p_partkey") % 100, F.lit("; cwe79"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.cwe_ids(text), ",").alias("cwes"))


def severity_from_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("l_quantity") / 5
    name = F.when(score > 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("unknown")
    level = F.when(name.isin("critical", "high"), "error").when(name == "medium", "warning").otherwise("note")
    return table(spark, sf_dir, "lineitem").groupBy(name.alias("severity"), level.alias("level")).agg(F.count("*").alias("n"))


def sarif_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the rules (brand and type) in their sorted distinct list; the list is a few hundred rows."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("rule"))
    rules = part.select("rule").distinct().withColumn("rule_index", (F.row_number().over(Window.orderBy("rule")) - 1).cast("long"))
    return part.join(rules, "rule").select("p_partkey", "rule", "rule_index")


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = views.located(views.occurrences(spark, sf_dir), spark, sf_dir)
    title = F.concat(F.when(F.col("line") % 2 == 0, F.lit(" =")).otherwise(F.lit("finding ")), F.col("finding_id"))
    return occ.select("occurrence_id", views.severity_name("sev").alias("severity"), F.coalesce("triage", F.lit("open")).alias("status"), T.guarded_cell(title).alias("title"), T.guarded_cell(F.col("path")).alias("path"), "start_line", "end_line")


def shard_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t).select("doc_id").distinct() for t in ("documents", "labels"))
    missing = docs.join(labels, "doc_id", "left_anti").withColumn("kind", F.lit("missing"))
    return missing.unionAll(labels.join(docs, "doc_id", "left_anti").withColumn("kind", F.lit("unknown")))


def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels override what documents say: both sides' ids, the labels' value first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("long").alias("staged"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("unstaged"))
    return docs.join(labels, "doc_id", "full_outer").select("doc_id", F.coalesce("unstaged", "staged").alias("value"))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, or whose label leaves them open, by kind."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    kind = F.when(F.col("lo").isNull(), "missing").when(F.col("lo") != F.col("hi"), "conflicting").when(F.col("hi") == 0, "needs_follow_up")
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", kind.alias("kind")).where("kind IS NOT NULL")


def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(F.coalesce("text", F.lit(""))).alias("lines"))


def preview_sample(spark: SparkSession, sf_dir: str, head: int = 12, more: int = 10) -> DataFrame:
    """Lines of a text's preview: the first ones, then evenly spaced ones of the rest."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n"), lines.alias("l"))
    spread = F.expr(f"transform(sequence(0, {more} - 1), k -> {head} + k * (n - {head} - 1) div ({more} - 1))")
    places = F.when(F.col("n") <= head + more, F.expr("sequence(0, n - 1)")).otherwise(F.concat(F.expr(f"sequence(0, {head} - 1)"), spread))
    rows = docs.select("doc_id", "l", F.explode(places).alias("i"))
    return rows.select("doc_id", F.col("i").cast("long").alias("line"), F.length(F.element_at("l", (F.col("i") + 1).cast("int"))).cast("long").alias("width"))


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new snapshot of findings: later values replace, the first sight stays, unseen ones are kept."""
    rows = views.occurrences(spark, sf_dir)
    old = rows.where("yr <= 1996").groupBy("target_id", "finding_id").agg(F.min("yr").alias("created"), F.max(F.struct("yr", "sev")).alias("o"))
    new = rows.where("yr > 1996").groupBy("target_id", "finding_id").agg(F.min("yr").alias("first"), F.max(F.struct("yr", "sev")).alias("k"))
    both = old.join(new, ["target_id", "finding_id"], "full_outer")
    return both.select("target_id", "finding_id", F.coalesce("created", "first").alias("created"), F.coalesce("k.yr", "o.yr").alias("updated"), F.coalesce("k.sev", "o.sev").cast("long").alias("sev"))


def ancestor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders above each path, root first."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return _paths(spark, sf_dir).select("p_partkey", F.posexplode(up).alias("depth", "folder")).withColumn("depth", F.col("depth").cast("long"))


def uri_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of page addresses without query and fragment."""
    url = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:]+)", 1)).alias("host"), F.regexp_extract(url, r"^[a-z]+://[^/]+/(.*)$", 1).alias("path"))


QUERIES = {f.__name__: f for f in (path_in_scope, path_glob, fingerprints, candidates_merge, strongest_duplicate, cwe_extract, severity_from_score, sarif_rule_index, export_rows, shard_differences, override_merge, coverage_gaps, line_count, preview_sample, upsert_snapshot, ancestor_files, uri_paths)}
_P = "p AS (SELECT p_partkey, p_name, p_brand, p_size, p_brand || '/' || p_type || '/' || p_partkey AS path FROM part)"
_SLUG = "regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9._/-]+', '-', 'g'), '^[._/-]+|[._/-]+$', '', 'g')"
ORACLES = {
    "path_in_scope": f"WITH {_P} SELECT p_partkey, path FROM p WHERE path = 'Brand#2' OR starts_with(path, 'Brand#2/')",
    "path_glob": f"WITH {_P} SELECT p_partkey, path FROM p WHERE path GLOB 'Brand#1?/*[05]'",
    "fingerprints": f"WITH {_P}, f AS (SELECT p_partkey, {_SLUG} AS rule, '{T.ALGORITHM}:sha256:' || sha256('{T.ALGORITHM}' || chr(0) || p_brand || chr(0) || {_SLUG} || chr(0) || path || chr(0) || CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '' END) AS fingerprint FROM p) SELECT *, 'csf_' || sha256(fingerprint)[1:24] AS finding_id FROM f",
    "candidates_merge": "SELECT l_suppkey % 10 AS rule, l_partkey AS part, string_agg(DISTINCT l_returnflag, chr(10) ORDER BY l_returnflag) AS summary, string_agg(DISTINCT l_linestatus, chr(10) ORDER BY l_linestatus) AS evidence, count(*) AS n, 'candidate-' || sha256((l_suppkey % 10) || '|' || l_partkey)[1:16] AS candidate_id FROM lineitem GROUP BY 1, 2",
    "strongest_duplicate": f"WITH {views.SQL} SELECT target_id, part, severity, seq, line, reports FROM (SELECT *, count(*) OVER (PARTITION BY target_id, part) AS reports FROM li QUALIFY row_number() OVER (PARTITION BY target_id, part ORDER BY sev, seq, line, flag) = 1) JOIN names ON rank = sev",
    "cwe_extract": "SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct(list_filter([p_size, 79, p_partkey % 100], lambda n: n > 0))), lambda n: 'CWE-' || n), ',') AS cwes FROM part",
    "severity_from_score": "WITH s AS (SELECT CASE WHEN l_quantity / 5 > 9 THEN 'critical' WHEN l_quantity / 5 >= 7 THEN 'high' WHEN l_quantity / 5 >= 4 THEN 'medium' WHEN l_quantity > 0 THEN 'low' ELSE 'unknown' END AS severity FROM lineitem) SELECT severity, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM s GROUP BY 1, 2",
    "sarif_rule_index": "SELECT p_partkey, p_brand || '/' || p_type AS rule, dense_rank() OVER (ORDER BY p_brand || '/' || p_type) - 1 AS rule_index FROM part",
    "export_rows": f"WITH {views.SQL} SELECT occurrence_id, severity, coalesce(triage, 'open') AS status, CASE WHEN line % 2 = 0 THEN ''' =' ELSE 'finding ' END || finding_id AS title, path, start_line, end_line FROM loc JOIN names ON rank = sev",
    "shard_differences": "SELECT DISTINCT doc_id, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "override_merge": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CAST(coalesce(l.q, d.n_chars % 2) AS BIGINT) AS value FROM documents d FULL JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id",
    "coverage_gaps": "WITH l AS (SELECT doc_id, min(quality) AS lo, max(quality) AS hi FROM labels GROUP BY 1), k AS (SELECT doc_id, CASE WHEN lo IS NULL THEN 'missing' WHEN lo <> hi THEN 'conflicting' WHEN hi = 0 THEN 'needs_follow_up' END AS kind FROM documents LEFT JOIN l USING (doc_id)) SELECT * FROM k WHERE kind IS NOT NULL",
    "line_count": "SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 1 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text[-1] = chr(10) THEN 0 ELSE 1 END END AS BIGINT) AS lines FROM documents",
    "preview_sample": """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), i AS (
      SELECT doc_id, l, unnest(CASE WHEN len(l) <= 22 THEN range(0, len(l)) ELSE list_concat(range(0, 12), list_transform(range(0, 10), lambda k: 12 + k * (len(l) - 13) // 9)) END) AS i FROM d)
      SELECT doc_id, i AS line, length(l[i + 1]) AS width FROM i""",
    "upsert_snapshot": f"""WITH {views.SQL} SELECT target_id, finding_id, min(yr) AS created, max(yr) AS updated, CAST(arg_max(sev, yr) AS BIGINT) AS sev FROM occ GROUP BY 1, 2""",
    "ancestor_files": f"WITH {_P} SELECT p_partkey, unnest([0, 1]) AS depth, unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS folder FROM p",
    "uri_paths": r"SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://([^/:]+)', 1)) AS host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+/(.*)$', 1) AS path FROM pages",
}
