"""Findings as other formats: SARIF, CSV, canonical JSON, Markdown, line hashes, rendered statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import linehash
from quarry.functions import text as T
from quarry.functions.bounded import bounded_json
from quarry.operators.compare import COMPARE_SQL, compare_status_by_target
from quarry.plans import views
from quarry.plans.views import table

#: Fixed: the columns of a findings file.
COLUMNS = ["occurrence_id", "scan_id", "finding_id", "title", "severity", "confidence", "status", "close_reason", "path", "start_line", "end_line", "cwe", "summary"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = views.located(views.occurrences(spark, sf_dir), spark, sf_dir)
    return occ.select(
        "occurrence_id", "scan_id", "target_id", "finding_id", F.concat(F.lit("finding "), "finding_id").alias("title"), views.severity_name("sev").alias("severity"), "sev",
        F.when(F.col("line") % 2 == 0, "high").otherwise("low").alias("confidence"), F.coalesce("triage", F.lit("open")).alias("status"), F.coalesce("reason", F.lit("")).alias("close_reason"),
        "path", "start_line", "end_line", F.concat(F.lit("CWE-"), F.col("finding_id") % 7).alias("cwe"), F.concat(F.when(F.col("line") % 3 == 0, F.lit("=sum(")).otherwise(F.lit('a "quoted", text (')), "part", F.lit(")")).alias("summary"),
    )


def sarif_documents(rows: DataFrame, tool: str = "quarry") -> DataFrame:
    """(scan_id, results, document): a SARIF document a scan of findings (scan_id, target_id, finding_id, occurrence_id, rule, sev, title, path, start_line, end_line).

    Rules are in order, results by occurrence with their rule's place, level, location and
    fingerprint. The findings of a scan meet in one task, as its document is one value.
    """
    level = F.when(F.col("sev") <= 1, "error").when(F.col("sev") == 2, "warning").otherwise("note")
    rules = rows.groupBy("scan_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    rows = rows.join(rules, "scan_id")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation"))
    result = F.to_json(F.struct(F.col("rule").alias("ruleId"), (F.array_position("rules", F.col("rule")) - 1).alias("ruleIndex"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.sha2(F.concat_ws("|", "target_id", "finding_id"), 256).alias("finding/v1")).alias("partialFingerprints")))
    agg = rows.groupBy("scan_id", "rules").agg(F.array_sort(F.collect_list(F.struct("occurrence_id", result.alias("j")))).alias("l"))
    ids = F.array_join(F.transform("rules", lambda r: F.concat(F.lit('{"id":"'), r, F.lit('"}'))), ",")
    text = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"'), F.lit(tool), F.lit('","rules":['), ids, F.lit(']}},"results":['), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]}]}"))
    return agg.select("scan_id", F.size("l").cast("long").alias("results"), text.alias("document"))


def sarif_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the SARIF documents of all scans."""
    rows = _rows(spark, sf_dir).withColumn("rule", F.concat(F.lit("rule-"), F.lpad((F.col("finding_id") % 7).cast("string"), 2, "0")))
    return sarif_documents(rows).select("scan_id", "results", F.sha2("document", 256).alias("digest"))


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as the cells of a CSV file of 13 columns, no cell a formula; quoted where need be."""
    cells = [T.guarded_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in COLUMNS]
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    return _rows(spark, sf_dir).select("occurrence_id", F.concat_ws(",", *quoted).alias("line"))


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as compact JSON whose keys stand in the order of their code points, with their digest."""
    doc = F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(["severity", "path", "title", "end_line", "start_line", "cwe"])]))
    return _rows(spark, sf_dir).where("path IS NOT NULL").select("occurrence_id", doc.alias("doc"), F.sha2(doc, 256).alias("digest"))


def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a scan: a summary of severities, then the findings of each; only counts and one scan's findings meet."""
    rows = _rows(spark, sf_dir)
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), cell(F.col("path")), F.lit(":"), F.col("start_line"), F.lit(")"))
    groups = rows.groupBy("scan_id", "sev", "severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("finding_id", line.alias("t")))).alias("l"))
    part = F.struct("sev", F.concat(F.lit("| "), "severity", F.lit(" | "), "n", F.lit(" |")).alias("row"), F.concat(F.lit("## "), "severity", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("text"))
    scans = groups.groupBy("scan_id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.sum("n").alias("n"))
    text = F.concat(F.lit("# Scan "), "scan_id", F.lit("\n\n| severity | findings |\n|-|-|\n"), F.array_join(F.transform("p", lambda x: x["row"]), "\n"), F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"))
    return scans.select("scan_id", F.col("n").alias("findings"), F.md5(text).alias("report"))


def rendered_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a comparison is shown: unknown findings whose path was not looked at are told apart as not rescanned."""
    rows = compare_status_by_target(spark, sf_dir)
    shown = F.when((F.col("status") == "unknown") & (F.col("n_after") == 0), "not_rescanned").otherwise(F.col("status"))
    return rows.groupBy("before_scan", "after_scan", shown.alias("shown")).agg(F.count("*").alias("n"))


def line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, hash) of all lines of all texts."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    found = docs.select("doc_id", F.posexplode(linehash.line_hashes(F.coalesce("text", F.lit("")))).alias("line", "hash"))
    return found.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), "hash")


def bounded_details(spark: SparkSession, sf_dir: str, most: int = 160) -> DataFrame:
    """Details of documents as JSON of at most so many bytes: what stays of the text, and the bytes of it all."""
    details = F.to_json(F.struct("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")))
    cut = table(spark, sf_dir, "documents").select("doc_id", bounded_json(details, most).alias("j"))
    text = F.try_variant_get(F.try_parse_json("j"), "$.text", "string")
    return cut.select("doc_id", F.length(text).cast("long").alias("kept"), F.octet_length("j").cast("long").alias("bytes"))


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest finding of each scan, the first on a tie, with its place among the scan's."""
    rows = _rows(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("scan_id").orderBy("occurrence_id")))
    best = rows.groupBy("scan_id").agg(F.min_by(F.struct("occurrence_id", "severity", "place"), F.struct("sev", "place")).alias("k"))
    return best.select("scan_id", "k.occurrence_id", "k.severity", F.col("k.place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (sarif_export, csv_export, canonical_json, markdown_reports, rendered_statuses, line_hashes, bounded_details, representatives)}

_X = """x AS (SELECT occurrence_id, scan_id, target_id, finding_id, 'finding ' || finding_id AS title, severity, sev, CASE WHEN line % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, coalesce(triage, 'open') AS status, coalesce(reason, '') AS close_reason, path, start_line, end_line,
  'CWE-' || finding_id % 7 AS cwe, CASE WHEN line % 3 = 0 THEN '=sum(' ELSE 'a "quoted", text (' END || part || ')' AS summary FROM loc JOIN names ON rank = sev)"""
ORACLES = {
    "sarif_export": f"""WITH {views.SQL}, {_X}, r AS (SELECT *, 'rule-' || lpad(CAST(finding_id % 7 AS VARCHAR), 2, '0') AS rule FROM x), i AS (SELECT *, dense_rank() OVER (PARTITION BY scan_id ORDER BY rule) - 1 AS i FROM r),
      j AS (SELECT scan_id, count(*) AS results, '{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"quarry","rules":[' || string_agg(DISTINCT '{{"id":"' || rule || '"}}', ',' ORDER BY '{{"id":"' || rule || '"}}') || ']}}}},"results":[' ||
        string_agg('{{"ruleId":"' || rule || '","ruleIndex":' || i || ',"level":"' || CASE WHEN sev <= 1 THEN 'error' WHEN sev = 2 THEN 'warning' ELSE 'note' END || '","message":{{"text":"' || title || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":{{"startLine":' || start_line || ',"endLine":' || end_line || '}}}}}}],"partialFingerprints":{{"finding/v1":"' || sha256(target_id || '|' || finding_id) || '"}}}}', ',' ORDER BY occurrence_id) || ']}}]}}' AS t FROM i GROUP BY 1)
      SELECT scan_id, results, sha256(t) AS digest FROM j""",
    "csv_export": f"""WITH {views.SQL}, {_X} SELECT occurrence_id, concat_ws(',', occurrence_id, scan_id, finding_id, title, severity, confidence, status, close_reason, coalesce(path, ''), coalesce(CAST(start_line AS VARCHAR), ''), coalesce(CAST(end_line AS VARCHAR), ''), cwe,
      CASE WHEN starts_with(summary, '=') THEN '''' || summary ELSE '"' || replace(summary, '"', '""') || '"' END) AS line FROM x""",
    "canonical_json": f"""WITH {views.SQL}, {_X}, d AS (SELECT occurrence_id, '{{"cwe":"' || cwe || '","end_line":' || end_line || ',"path":"' || path || '","severity":"' || severity || '","start_line":' || start_line || ',"title":"' || title || '"}}' AS doc FROM x WHERE path IS NOT NULL) SELECT occurrence_id, doc, sha256(doc) AS digest FROM d""",
    "markdown_reports": f"""WITH {views.SQL}, {_X}, g AS (SELECT scan_id, sev, severity, count(*) AS n, '## ' || severity || chr(10) || string_agg('- ' || title || ' (' || coalesce(path, '') || ':' || start_line || ')', chr(10) ORDER BY finding_id) AS t FROM x GROUP BY 1, 2, 3)
      SELECT scan_id, CAST(sum(n) AS BIGINT) AS findings, md5('# Scan ' || scan_id || chr(10) || chr(10) || '| severity | findings |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || severity || ' | ' || n || ' |', chr(10) ORDER BY sev) || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY sev)) AS report FROM g GROUP BY 1""",
    "bounded_details": """WITH d AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(text, '') AS t FROM documents
      ), l AS (SELECT doc_id, t, 2 + 9 + length(CAST(doc_id AS VARCHAR)) + 1 + 9 + length(s) + 2 + 1 + 7 AS used FROM d
      ), c AS (SELECT doc_id, used, i, CASE WHEN i = 0 THEN 2 WHEN substr(t, i, 1) IN ('"', chr(92), chr(8), chr(9), chr(10), chr(12), chr(13)) THEN 2 WHEN unicode(substr(t, i, 1)) BETWEEN 32 AND 126 THEN 1 WHEN unicode(substr(t, i, 1)) < 65536 THEN 6 ELSE 12 END AS cost
        FROM l, range(0, 161) AS r(i) WHERE i <= length(t)
      ), u AS (SELECT doc_id, used, i, sum(cost) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM c)
      SELECT doc_id, max(i) AS kept, CAST(max(used + total) AS BIGINT) AS bytes FROM u WHERE used + total <= 160 GROUP BY doc_id""",
    "rendered_statuses": f"{COMPARE_SQL} SELECT before_scan, after_scan, CASE WHEN status = 'unknown' AND n_after = 0 THEN 'not_rescanned' ELSE status END AS shown, count(*) AS n FROM status GROUP BY 1, 2, 3",
    "representatives": f"WITH {views.SQL}, {_X}, p AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY occurrence_id) AS place FROM x) SELECT scan_id, occurrence_id, severity, place FROM p QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY sev, place) = 1",
}
