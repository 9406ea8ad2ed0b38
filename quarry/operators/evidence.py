"""Evidence, coverage reconciliation, rules and checks over findings, source lines and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans import views
from quarry.plans.session import materialize
from quarry.plans.views import table

#: Category, weakness ids and the words of which all must be in a text; the first rule that holds wins.
RULES = [
    ("large-hot", "CWE-400", ["large", "hot"]), ("hot-surface", "CWE-79", ["hot"]), ("cold-storage", "CWE-522,CWE-798", ["cold"]), ("small-part", "CWE-20", ["small"]),
    ("gadget", "CWE-918", ["gadget"]), ("widget", "CWE-601", ["widget"]), ("gear", "CWE-22", ["gear"]),
]
DEFAULT = ("security-defect", "")
#: Validation words that say a finding is none.
NEGATIVE = ["false positive", "not vulnerable", "not exploitable"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))


def taxonomy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and weaknesses of part names by the first rule whose words are all there."""
    name = F.lower("p_name")
    category, cwes = F.lit(DEFAULT[0]), F.lit(DEFAULT[1])
    for rule, ids, words in reversed(RULES):
        holds = F.lit(True)
        for w in words:
            holds = holds & name.contains(w)
        category, cwes = F.when(holds, rule).otherwise(category), F.when(holds, ids).otherwise(cwes)
    return table(spark, sf_dir, "part").select("p_partkey", category.alias("category"), cwes.alias("cwes"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, end, snippet): a snippet claimed of each text; every third is altered, every fifth lies past the end."""
    rows = _lines(spark, sf_dir).withColumn("start", (F.col("doc_id") % 4 + 1).cast("int")).withColumn("end", (F.col("start") + F.col("doc_id") % 3).cast("int"))
    real = F.array_join(F.slice("l", F.col("start"), F.col("end") - F.col("start") + 1), "\n")
    moved = F.when(F.col("doc_id") % 5 == 0, 100_000).otherwise(0)
    return rows.select("doc_id", (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"), F.when(F.col("doc_id") % 3 == 0, F.concat(real, F.lit("!"))).otherwise(real).alias("snippet"))


def evidence_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims set against their source: what stands there is taken (41 lines at most), what points nowhere is removed."""
    both = claims(spark, sf_dir).join(_lines(spark, sf_dir), "doc_id")
    last = F.least(F.col("end"), F.col("start") + 40, F.size("l"))
    real = F.array_join(F.slice("l", F.col("start"), F.greatest(last - F.col("start") + 1, F.lit(0))), "\n")
    kind = F.when(F.col("start") > F.size("l"), "removed").when(real == F.col("snippet"), "kept").otherwise("re-anchored")
    return both.select("doc_id", kind.alias("kind"), F.when(kind != "removed", F.md5(real)).alias("lines"))


def evidence_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of orders to parts: repeated ones once, unknown ones marked."""
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, F.col("l_partkey") + 10**6).otherwise(F.col("l_partkey")).alias("ref")).distinct()
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    return refs.join(catalog, F.col("ref") == F.col("k"), "left").select("l_orderkey", "ref", F.col("k").isNotNull().alias("known"), F.col("p_name").alias("name"))


def artifact_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries whose artifact is missing or has another digest, and artifacts that no manifest seals."""
    actual = table(spark, sf_dir, "part").where("p_partkey % 17 <> 3").select("p_partkey", F.sha2("p_name", 256).alias("actual"))
    manifest = table(spark, sf_dir, "part").where("p_partkey % 19 <> 5").select("p_partkey", F.when(F.col("p_partkey") % 13 == 1, F.sha2("p_type", 256)).otherwise(F.sha2("p_name", 256)).alias("sealed"))
    both = manifest.join(actual, "p_partkey", "full_outer")
    fault = F.when(F.col("actual").isNull(), "missing").when(F.col("sealed").isNull(), "not sealed").when(F.col("actual") != F.col("sealed"), "changed")
    return both.select("p_partkey", fault.alias("fault")).where("fault IS NOT NULL")


def aligned_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of evidence lines: that of the flow with their id, else the one role of all endpoints that overlap them, else none.

    The endpoints of a path are put beside its part, so that occurrences are joined once, without their paths.
    """
    occ = views.occurrences(spark, sf_dir).select("occurrence_id", "part", (F.col("line") * 10).alias("s"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), "p_partkey").alias("path"), F.col("p_size").cast("long").alias("size")).where("path IS NOT NULL")
    ends = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type", "p_partkey").alias("path"), F.explode(F.array(F.struct(F.lit(10).alias("s0"), F.lit(25).alias("e0"), F.lit("source").alias("role")), F.struct(F.lit(24).alias("s0"), F.lit(60).alias("e0"), F.lit("sink").alias("role")))).alias("p")).select("path", "p.*")
    beside = parts.join(ends.groupBy("path").agg(F.collect_set(F.struct("s0", "e0", "role")).alias("ends")), "path", "left").select("part", "size", "ends")
    near = F.filter("ends", lambda x: (F.col("s") <= x["e0"]) & (x["s0"] <= F.col("s") + F.col("size")))
    both = occ.join(beside, "part").withColumn("roles", F.array_distinct(F.transform(near, lambda x: x["role"])))
    flow = F.when(F.col("occurrence_id") % 4 == 0, F.lit("propagation"))
    return both.select("occurrence_id", F.coalesce(flow, F.when(F.size("roles") == 1, F.element_at("roles", 1))).alias("role"))


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, disposition, deferred) of labelled documents: surfaces of a coverage report."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return labels.select("doc_id", F.when(F.col("quality") == 1, "no_issue").otherwise("needs_follow_up").alias("disposition"), (F.col("doc_id") % 3 == 0).alias("deferred"), "toxic")


def coverage_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces after findings are known: reported where a finding names it, no longer deferred then; documents without a surface need follow-up."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("target"), F.col("n_chars"))
    rows = docs.join(_surfaces(spark, sf_dir), "doc_id", "left")
    found = F.coalesce((F.col("toxic") == 1) & (F.col("n_chars") > 200), F.lit(False))
    disposition = F.when(F.col("disposition").isNull(), "needs_follow_up").when(found, "reported").otherwise(F.col("disposition"))
    return rows.select("target", "doc_id", disposition.alias("disposition"), F.coalesce(~found & (F.col("deferred") | (F.col("disposition") == "needs_follow_up")), F.lit(True)).alias("deferred"), F.col("disposition").isNull().alias("synthesized"))


def coverage_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each target's coverage is complete: nothing is deferred, nothing was added; and which surfaces are both closed and deferred."""
    rows = coverage_reconcile(spark, sf_dir)
    closed = F.col("disposition").isin("reported", "no_issue")
    agg = rows.groupBy("target").agg(F.count("*").alias("surfaces"), F.count_if("synthesized").alias("added"), F.count_if(closed & F.col("deferred")).alias("both"), F.bool_and(~F.col("deferred")).alias("closed"))
    return agg.select("target", "surfaces", "added", "both", F.when(F.col("closed"), "complete").otherwise("partial").alias("completeness"))


def exact_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the shards of each brand, put together in their order, differ from its list of parts."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    right = part.withColumn("place", F.row_number().over(w).cast("long"))
    moved = F.when((F.col("p_partkey") % 47 == 5), F.col("p_partkey") + 3).otherwise(F.col("p_partkey"))
    shards = right.where("p_partkey % 53 <> 9").withColumn("p_partkey", moved).withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy("place")).cast("long"))
    both = right.join(shards.withColumnRenamed("p_partkey", "given"), ["p_brand", "place"], "full_outer")
    return both.where("NOT (p_partkey <=> given)").select("p_brand", "place", "p_partkey", "given")


def duplicated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by candidate: the explicit id, else the fallback of its order; distinct titles as first seen, levels in their order."""
    rows = table(spark, sf_dir, "lineitem").select(F.coalesce(F.when(F.col("l_returnflag") == "A", F.concat(F.lit("c"), F.col("l_partkey") % 50)), F.concat(F.lit("o"), F.col("l_orderkey") % 100)).alias("candidate"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    titles = rows.groupBy("candidate", F.concat(F.lit("title "), F.col("l_partkey") % 7).alias("title")).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("first"), F.count("*").alias("n"), F.collect_set("l_returnflag").alias("levels"))
    agg = titles.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("first", "title"))).alias("t"), F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("levels")))).alias("levels"))
    return agg.select("candidate", "n", F.array_join(F.transform("t", lambda x: x["title"]), "; ").alias("titles"), F.array_join("levels", ",").alias("levels"))


def strongest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest report of a finding by severity, then confidence, then evidence; the first on a tie."""
    rows = views.findings(spark, sf_dir).withColumn("confidence", F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 1).otherwise(2)).withColumn("evidence", F.col("line") % 3)
    best = rows.groupBy("scan_id", "finding_id").agg(F.min(F.struct("sev", "confidence", (-F.col("evidence")).alias("less"), "seq", "part", "line")).alias("k"))
    return best.select("scan_id", "finding_id", views.severity_name(F.col("k.sev")).alias("severity"), F.col("k.confidence").cast("long").alias("confidence"), F.col("k.seq").alias("seq"), F.col("k.line").alias("line"))


def layered_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by the layer that comes first: user, then project, then default."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_size")
    layers = [base.where("key % 2 = 0").select("key", F.lit(0).alias("rank"), F.concat(F.lit("user "), "p_size").alias("value")), base.where("key % 3 = 0").select("key", F.lit(1).alias("rank"), F.concat(F.lit("project "), "p_size").alias("value")), base.where("key % 7 <> 0").select("key", F.lit(2).alias("rank"), F.lit("default").alias("value"))]
    rows = layers[0].unionAll(layers[1]).unionAll(layers[2]).groupBy("key").agg(F.min_by("value", "rank").alias("value"))
    return base.select("key").join(rows, "key", "left")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements on settings: pass or fail where the setting is known, else unknown."""
    actual = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size"))
    passed = F.when(F.col("p_partkey") % 3 == 0, actual >= 10).when(F.col("p_partkey") % 3 == 1, actual < 30).otherwise(actual == 25)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(actual.isNull(), "unknown").when(passed, "pass").otherwise("fail").alias("result"))


def policy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies that apply to each part's folder, of the root first, joined."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("folder"))
    parts = F.split("folder", "/")
    above = part.select("p_partkey", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.when(i == 0, ".").otherwise(F.array_join(F.slice(parts, 1, i), "/")).alias("at")))).alias("a")).select("p_partkey", "a.*")
    files = part.select(F.explode(F.array(F.lit("."), F.split("folder", "/")[0], "folder")).alias("at")).distinct().where("at NOT LIKE '%3'").select("at", F.concat(F.lit("policy of "), "at").alias("text"))
    rows = above.join(files, "at").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("depth", "text"))).alias("l"))
    return rows.select("p_partkey", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("policies"))


def report_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that a report lacks; reports of parts leave one out by their number."""
    wanted = ["Summary", "Scope", "Findings"]
    text = F.concat_ws("\n", F.when(F.col("p_partkey") % 3 != 0, F.lit("# Summary")), F.col("p_name"), F.when(F.col("p_partkey") % 4 != 0, F.lit("## Scope")), F.lit("no # Scope here"), F.when(F.col("p_partkey") % 5 != 0, F.lit("## Findings")))
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,2} (\w+)$"), 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_except(F.array(*[F.lit(w) for w in wanted]), heads)).alias("missing"))
    return rows


def real_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reportable findings that no validation calls a false alarm: severity of low or more, verdict not negative."""
    verdict = F.when(F.col("finding_id") % 5 == 0, F.lit("Not_Vulnerable ")).when(F.col("finding_id") % 7 == 0, F.lit("confirmed"))
    plain = F.lower(F.trim(F.replace(verdict, F.lit("_"), F.lit(" "))))
    occ = views.occurrences(spark, sf_dir).where((F.col("sev") <= 3) & ~F.coalesce(plain.isin(*NEGATIVE), F.lit(False)) & F.coalesce(F.col("seq") % 11 != 0, F.lit(True)))
    return occ.select("occurrence_id", views.severity_name("sev").alias("severity"))


def substantive(text: Column, least: int) -> Column:
    """Whether a text says something: long enough and no placeholder."""
    return F.coalesce((F.length(F.trim(text)) >= least) & ~F.lower(F.trim(text)).rlike(r"^(?:n/?a|none|tbd|todo|unknown|placeholder)\b"), F.lit(False))


def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether validation, attack path and code evidence of parts are substantive."""
    k = F.col("p_partkey")
    validation = F.when(k % 4 == 0, F.lit("TODO: look at this once more")).otherwise(F.concat("p_name", F.lit(" is read without a check")))
    path = F.when(k % 5 == 0, F.lit(" n/a ")).otherwise(F.concat("p_name", F.lit(" to "), "p_type"))
    code = F.when(k % 3 != 0, F.lit("f()")).when(k % 2 == 0, F.lit("x"))
    return table(spark, sf_dir, "part").select("p_partkey", substantive(validation, 20).alias("validated"), substantive(path, 8).alias("attack_path"), substantive(code, 3).alias("code"))


def severity_gate(spark: SparkSession, sf_dir: str, threshold: int = 1) -> DataFrame:
    """Scans against a gate of high: failed by findings at or above it, undecidable where coverage is not complete."""
    counts = views.occurrences(spark, sf_dir).groupBy("scan_id").agg(F.count_if(F.col("sev") <= threshold).alias("n"))
    rows = views.scans(spark, sf_dir).join(counts, "scan_id")
    return rows.select("scan_id", "n", F.when(~F.col("complete"), "undecidable").when(F.col("n") > 0, "failed").otherwise("passed").alias("gate"))


def recent_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders since a cutoff, archived ones and forks left out; the filter reaches the file scan."""
    rows = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00' AND o_orderstatus <> 'P' AND o_orderkey % 13 <> 0")
    return rows.select("o_orderkey", "o_orderdate")


def id_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight characters of every part's id, and whether they name it alone."""
    ids = table(spark, sf_dir, "part").select("p_partkey", F.md5(F.concat(F.lit("part "), (F.expr("p_partkey div 2")).cast("string"))).alias("id"))
    counts = ids.groupBy(F.substring("id", 1, 8).alias("prefix")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return counts.select("prefix", F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("state"), F.when(F.col("n") == 1, F.col("first")).alias("p_partkey"))


def null_safe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language, those without one counted as a language of their own, by a null-safe join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    langs = docs.select(F.col("lang").alias("l")).distinct()
    return docs.join(langs, F.col("lang").eqNullSafe(F.col("l"))).groupBy("l").agg(F.count("*").alias("n")).select(F.col("l").alias("lang"), "n")


def row_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of three times of a row; null if any is null."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("m"), F.min("l_shipdate").alias("n")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    all_there = F.col("m").isNotNull() & F.col("n").isNotNull() & F.col("o_orderdate").isNotNull()
    return rows.select("o_orderkey", F.when(all_there, F.greatest("o_orderdate", "m", "n")).alias("t"))


def camel_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as documents with camel-case names; null fields are left out."""
    doc = F.to_json(F.struct(F.col("p_partkey").alias("partKey"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("brandName"), F.col("p_size").alias("partSize")))
    return table(spark, sf_dir, "part").select("p_partkey", doc.alias("doc"))


def unique_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls resolved by folder and name where the definition is the only one."""
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("folder"), (F.col("p_partkey") % 11).alias("name"))
    single = named.groupBy("folder", "name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("definition")).where("n = 1").drop("n")
    calls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("caller"), F.concat_ws("/", "p_brand", "p_type").alias("folder"), (F.col("p_partkey") % 7).alias("name"))
    return calls.join(single, ["folder", "name"]).select("caller", "definition")


def call_reach(spark: SparkSession, sf_dir: str, depth: int = 4) -> DataFrame:
    """How near each part is to a sink (every 50th) along calls, no more than so many calls away; a round a call."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    calls = part.where("p_partkey > 0").select(F.col("p_partkey").alias("caller"), F.expr("p_partkey div 2").alias("callee")).unionAll(part.select(F.col("p_partkey").alias("caller"), (F.col("p_partkey") + 1).alias("callee")))
    front = part.where("p_partkey % 50 = 0").select("p_partkey", F.lit(0).alias("depth"))
    seen = front
    for d in range(1, depth + 1):
        near = calls.join(front.select("p_partkey"), F.col("callee") == F.col("p_partkey")).select(F.col("caller").alias("p_partkey")).distinct()
        front = materialize(near.join(seen, "p_partkey", "left_anti").join(part, "p_partkey").withColumn("depth", F.lit(d)))
        seen = seen.unionAll(front)
    return seen.select("p_partkey", F.col("depth").cast("long").alias("depth"))


def consumers(made: DataFrame, used: DataFrame) -> DataFrame:
    """(producer, consumer, artifact) of made (producer, workflow, artifact) and used (consumer, workflow, wanted).

    A consumer wants an artifact by its path or by that of a folder above it, so an artifact goes out
    under its own path and all folders above, and the join is on workflow and path alone.
    """
    parts = F.split("artifact", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    offered = made.withColumn("wanted", F.explode(F.array_distinct(above)))
    return offered.join(used, ["workflow", "wanted"]).select("producer", "consumer", "artifact")


def artifact_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers of a workflow's artifact: of its name, or of a folder that holds it."""
    made = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("producer"), F.col("p_brand").alias("workflow"), F.concat_ws("/", "p_type", F.col("p_partkey") % 10).alias("artifact"))
    used = table(spark, sf_dir, "part").where("p_partkey % 9 = 1").select(F.col("p_partkey").alias("consumer"), F.col("p_brand").alias("workflow"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat_ws("/", "p_type", F.col("p_partkey") % 10)).alias("wanted"))
    return consumers(made, used)


QUERIES = {f.__name__: f for f in (taxonomy_rules, evidence_ground, evidence_references, artifact_digests, aligned_roles, coverage_reconcile, coverage_completeness, exact_partition, duplicated_values, candidate_groups, strongest_reports, layered_config, requirements, policy_files, report_format, real_findings, evidence_quality, severity_gate, recent_repositories, id_prefixes, null_safe_counts, row_maximum, camel_documents, unique_definitions, call_reach, artifact_consumers)}
_WHEN = lambda at: " ".join(f"WHEN {' AND '.join(f'contains(lower(p_name), {w!r})' for w in r[2])} THEN {r[at]!r}" for r in RULES)
_SURFACE = """s AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'no_issue' ELSE 'needs_follow_up' END AS d, doc_id % 3 = 0 AS f, max(toxic) AS toxic FROM labels GROUP BY 1
), r AS (SELECT coalesce(source, 'none') AS target, doc_id, d, f, coalesce(toxic = 1 AND n_chars > 200, false) AS found FROM documents LEFT JOIN s USING (doc_id)
), c AS (SELECT target, doc_id, CASE WHEN d IS NULL THEN 'needs_follow_up' WHEN found THEN 'reported' ELSE d END AS disposition, coalesce(NOT found AND (f OR d = 'needs_follow_up'), true) AS deferred, d IS NULL AS synthesized FROM r)"""
ORACLES = {
    "taxonomy_rules": f"SELECT p_partkey, CASE {_WHEN(0)} ELSE '{DEFAULT[0]}' END AS category, CASE {_WHEN(1)} ELSE '' END AS cwes FROM part",
    "evidence_ground": """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, doc_id % 4 + 1 AS s, doc_id % 4 + 1 + doc_id % 3 AS e FROM documents), t AS (SELECT doc_id, array_to_string(l[s:e], chr(10)) AS t, s > len(l) AS beyond FROM l)
      SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR beyond THEN 'removed' WHEN doc_id % 3 = 0 THEN 're-anchored' ELSE 'kept' END AS kind, CASE WHEN NOT (doc_id % 5 = 0 OR beyond) THEN md5(t) END AS lines FROM t""",
    "evidence_references": "WITH r AS (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber = 1 THEN l_partkey + 1000000 ELSE l_partkey END AS ref FROM lineitem) SELECT l_orderkey, ref, p_partkey IS NOT NULL AS known, p_name AS name FROM r LEFT JOIN part ON ref = p_partkey",
    "artifact_digests": "SELECT * FROM (SELECT p_partkey, CASE WHEN p_partkey % 17 = 3 THEN CASE WHEN p_partkey % 19 <> 5 THEN 'missing' END WHEN p_partkey % 19 = 5 THEN 'not sealed' WHEN p_partkey % 13 = 1 AND p_name <> p_type THEN 'changed' END AS fault FROM part) WHERE fault IS NOT NULL",
    "aligned_roles": f"""WITH {views.SQL}, x AS (SELECT occurrence_id, start_line AS s, end_line AS e FROM loc WHERE path IS NOT NULL) SELECT occurrence_id, CASE WHEN occurrence_id % 4 = 0 THEN 'propagation' WHEN s <= 25 AND e >= 10 AND NOT (s <= 60 AND e >= 24) THEN 'source' WHEN s <= 60 AND e >= 24 AND NOT (s <= 25 AND e >= 10) THEN 'sink' END AS role FROM x""",
    "coverage_reconcile": f"WITH {_SURFACE} SELECT * FROM c",
    "coverage_completeness": f"WITH {_SURFACE} SELECT target, count(*) AS surfaces, count(*) FILTER (synthesized) AS added, count(*) FILTER (deferred AND disposition IN ('reported', 'no_issue')) AS both, CASE WHEN bool_and(NOT deferred) THEN 'complete' ELSE 'partial' END AS completeness FROM c GROUP BY 1",
    "exact_partition": """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part), s AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY place) AS place, CASE WHEN p_partkey % 47 = 5 THEN p_partkey + 3 ELSE p_partkey END AS given FROM r WHERE p_partkey % 53 <> 9)
      SELECT coalesce(r.p_brand, s.p_brand) AS p_brand, coalesce(r.place, s.place) AS place, p_partkey, given FROM r FULL JOIN s ON r.p_brand = s.p_brand AND r.place = s.place WHERE p_partkey IS DISTINCT FROM given""",
    "duplicated_values": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING n > 1",
    "candidate_groups": """WITH r AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'c' || l_partkey % 50 ELSE 'o' || l_orderkey % 100 END AS candidate, 'title ' || l_partkey % 7 AS title, (l_orderkey, l_linenumber, l_partkey) AS k, l_returnflag FROM lineitem), t AS (SELECT candidate, title, min(k) AS f, count(*) AS n FROM r GROUP BY 1, 2), l AS (SELECT candidate, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS levels FROM r GROUP BY 1)
      SELECT candidate, CAST(sum(n) AS BIGINT) AS n, string_agg(title, '; ' ORDER BY f, title) AS titles, any_value(levels) AS levels FROM t JOIN l USING (candidate) GROUP BY 1""",
    "strongest_reports": f"WITH {views.SQL}, c AS (SELECT *, CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS confidence FROM li) SELECT scan_id, finding_id, severity, confidence, seq, line FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY scan_id, finding_id ORDER BY sev, confidence, line % 3 DESC, seq, part, line) = 1) JOIN names ON rank = sev",
    "layered_config": "SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'user ' || p_size WHEN p_partkey % 3 = 0 THEN 'project ' || p_size WHEN p_partkey % 7 <> 0 THEN 'default' END AS value FROM part",
    "requirements": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN CASE p_partkey % 3 WHEN 0 THEN p_size >= 10 WHEN 1 THEN p_size < 30 ELSE p_size = 25 END THEN 'pass' ELSE 'fail' END AS result FROM part",
    "policy_files": "SELECT p_partkey, array_to_string(list_transform(list_filter(['.', p_brand, p_brand || '/' || p_type], lambda a: NOT ends_with(a, '3')), lambda a: 'policy of ' || a), chr(10)) AS policies FROM part",
    "report_format": "SELECT p_partkey, unnest(list_filter(['Summary', 'Scope', 'Findings'], lambda w: CASE w WHEN 'Summary' THEN p_partkey % 3 = 0 WHEN 'Scope' THEN p_partkey % 4 = 0 ELSE p_partkey % 5 = 0 END)) AS missing FROM part",
    "real_findings": f"WITH {views.SQL} SELECT occurrence_id, severity FROM occ JOIN names ON rank = sev WHERE sev <= 3 AND finding_id % 5 <> 0 AND seq % 11 <> 0",
    "evidence_quality": "SELECT p_partkey, p_partkey % 4 <> 0 AND length(trim(p_name || ' is read without a check')) >= 20 AS validated, p_partkey % 5 <> 0 AND length(p_name || ' to ' || p_type) >= 8 AS attack_path, p_partkey % 3 <> 0 AS code FROM part",
    "severity_gate": f"WITH {views.SQL}, n AS (SELECT scan_id, count(*) FILTER (sev <= 1) AS n FROM occ GROUP BY 1) SELECT scan_id, n, CASE WHEN NOT complete THEN 'undecidable' WHEN n > 0 THEN 'failed' ELSE 'passed' END AS gate FROM scans JOIN n USING (scan_id)",
    "recent_repositories": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' AND o_orderkey % 13 <> 0",
    "id_prefixes": "SELECT md5('part ' || p_partkey // 2)[1:8] AS prefix, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS state, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey FROM part GROUP BY 1",
    "null_safe_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
    "row_maximum": "SELECT o_orderkey, CASE WHEN m IS NOT NULL THEN greatest(o_orderdate, m) END AS t FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
    "camel_documents": """SELECT p_partkey, '{"partKey":' || p_partkey || CASE WHEN p_partkey % 3 <> 0 THEN ',"brandName":"' || p_brand || '"' ELSE '' END || ',"partSize":' || p_size || '}' AS doc FROM part""",
    "unique_definitions": "WITH d AS (SELECT p_brand, p_type, p_partkey % 11 AS name, min(p_partkey) AS definition FROM part GROUP BY 1, 2, 3 HAVING count(*) = 1) SELECT p_partkey AS caller, definition FROM part JOIN d ON part.p_brand = d.p_brand AND part.p_type = d.p_type AND part.p_partkey % 7 = name",
    "call_reach": """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey + 1 FROM part), r AS (SELECT p_partkey, 0 AS depth FROM part WHERE p_partkey % 50 = 0 UNION SELECT e.a, r.depth + 1 FROM r JOIN e ON e.b = r.p_partkey WHERE r.depth < 4)
      SELECT p_partkey, min(depth) AS depth FROM r GROUP BY 1""",
    "artifact_consumers": "WITH m AS (SELECT p_partkey AS producer, p_brand, p_type || '/' || p_partkey % 10 AS artifact FROM part WHERE p_partkey % 4 = 0), u AS (SELECT p_partkey AS consumer, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || '/' || p_partkey % 10 END AS wanted FROM part WHERE p_partkey % 9 = 1) SELECT producer, consumer, artifact FROM m JOIN u USING (p_brand) WHERE artifact = wanted OR starts_with(artifact, wanted || '/')",
}
