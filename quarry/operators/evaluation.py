"""Evaluation of detectors over cases and runs: matches, metrics, stability, negative cases, report comparison.

A case is a source of documents, with three runs whose detector marks texts over a length; toxic
texts are expected. Findings are matched with expectations by `matching`. Every seventh case's last
run failed: it reports nothing and misses all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import matching
from quarry.operators.scoring import adjacent, ratio
from quarry.plans import views
from quarry.plans.session import materialize
from quarry.plans.views import table

RUNS = 3
#: Metric, whether more is better, and its weight in the quality index.
QUALITY = [
    ("completion_rate", True, 0.12), ("precision", True, 0.14), ("recall", True, 0.16), ("f1", True, 0.12), ("case_pass_rate", True, 0.08), ("negative_case_pass_rate", True, 0.08),
    ("stable_detection_rate", True, 0.10), ("validation_rate", True, 0.05), ("attack_path_rate", True, 0.05), ("code_evidence_rate", True, 0.04), ("severity_accuracy", True, 0.03), ("false_positives_per_run", False, 0.03),
]
#: Fixed: a metric has regressed if it is worse by more than this.
TOLERANCE = 0.001
METRICS = [
    "case_count", "run_count", "completed_runs", "completion_rate", "expected_instances", "reported_findings", "true_positives", "false_positives", "false_negatives", "precision", "recall", "f1",
    "case_pass_rate", "negative_case_pass_rate", "stable_detection_rate", "validation_rate", "attack_path_rate", "code_evidence_rate", "severity_accuracy", "false_positives_per_run",
]


def outcomes(spark: SparkSession, sf_dir: str, base: int = 1500) -> DataFrame:
    """A row a run and labelled document that is expected or reported: (case_id, run, doc_id, completed, expected, found, and what a match is judged by).

    Expectations and findings are placed at their documents and matched one to one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("case_id"), "n_chars")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = materialize(docs.join(labels, "doc_id"))
    runs = rows.select("case_id").distinct().withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))
    failed = (F.col("run") == RUNS - 1) & (F.try_to_number(F.regexp_extract("case_id", r"(\d+)$", 1), F.lit("999999")).cast("int") % 7 == 0)
    runs = runs.withColumn("completed", ~F.coalesce(failed, F.lit(False)))
    path, cwes = F.concat(F.lit("d"), F.col("doc_id")).alias("path"), F.array(F.concat(F.lit("CWE-"), F.col("doc_id") % 9 + 1)).alias("cwes")
    line = F.col("doc_id") % 500 + 1
    severities = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("high"), F.lit("critical")))
    expected = rows.where("toxic = 1").select("case_id", F.col("doc_id").alias("a"), cwes, path, line.alias("start_line"), (line + 3).alias("end_line"), F.lit(2).alias("near"), severities.alias("severities"))
    found = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1)))).where(F.col("n_chars") > base + 500 * F.col("run")).select(
        "case_id", "run", F.col("doc_id").alias("b"), cwes, path, (line + 5).alias("start_line"), F.lit(None).cast("long").alias("end_line"),
        (F.col("n_chars") % 2 == 0).alias("validated"), (F.col("n_chars") % 3 != 0).alias("attack_path"), (F.col("n_chars") % 5 != 0).alias("evidence"), F.when(F.col("doc_id") % 5 != 0, "high").otherwise("low").alias("severity"),
    )
    pairs = matching.matching(matching.candidates(expected, found), ["case_id", "run"])
    return matching.outcomes_of(expected, found, runs, pairs).withColumnRenamed("item", "doc_id")


def run_results(rows: DataFrame) -> DataFrame:
    """Confusion and quality counts of each run; a failed run misses everything expected."""
    hit = F.col("expected") & F.col("found")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("case_id", "run").agg(
        F.bool_and("completed").alias("completed"), count(F.col("expected")).alias("expected"), count(F.col("found")).alias("reported"), count(hit).alias("tp"),
        count(~F.col("expected") & F.col("found")).alias("fp"), count(F.col("expected") & ~F.col("found")).alias("fn"), count(hit & F.col("validated")).alias("validated"),
        count(hit & F.col("attack_path")).alias("attack_paths"), count(hit & F.col("evidence")).alias("evidence"), count(hit & F.col("severity_ok").isNotNull()).alias("judged"), count(hit & F.col("severity_ok")).alias("severity_ok"),
    )


def stability(rows: DataFrame) -> DataFrame:
    """(case_id, doc_id, state) of every expectation: found in every run, in some, or in none."""
    each = rows.where("expected").groupBy("case_id", "doc_id").agg(F.bool_and("found").alias("all"), F.bool_or("found").alias("any"))
    return each.select("case_id", "doc_id", F.when(F.col("all"), "stable").when(F.col("any"), "unstable").otherwise("missed").alias("state"))


def case_results(rows: DataFrame) -> DataFrame:
    """One row a case: sums over its runs, its stable and unstable expectations, and whether every run passed."""
    passed = F.col("completed") & (F.col("fp") == 0) & (F.col("fn") == 0)
    runs = run_results(rows).groupBy("case_id").agg(F.max("expected").alias("expected"), F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.bool_and(passed).alias("passed"))
    states = stability(rows).groupBy("case_id").agg(F.count_if(F.col("state") == "stable").alias("stable"), F.count_if(F.col("state") == "unstable").alias("unstable"))
    return runs.join(states, "case_id", "left").fillna(0, ["stable", "unstable"])


def all_metrics(rows: DataFrame) -> DataFrame:
    """(metric, value) of all cases: rates of sums; an empty rate is 1, false positives a run 0."""
    runs = run_results(rows)
    clean = F.col("completed") & (F.col("fp") == 0)
    sums = runs.agg(
        F.count("*").alias("run_count"), F.count_if("completed").alias("completed_runs"), F.count_if(F.col("expected") == 0).alias("negative"), F.count_if((F.col("expected") == 0) & clean).alias("negative_passed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "reported", "tp", "fp", "fn", "validated", "attack_paths", "evidence", "judged", "severity_ok")],
    )
    cases = case_results(rows).agg(F.count("*").alias("case_count"), F.count_if("passed").alias("passed"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expectations"), F.coalesce(F.sum("stable"), F.lit(0)).alias("stable"))
    one = sums.crossJoin(F.broadcast(cases))  # a row each
    of = lambda n, d, empty=1.0: ratio(F.col(n), F.col(d), empty)
    one = one.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0))
    one = one.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))
    made = {
        "completion_rate": of("completed_runs", "run_count"), "expected_instances": F.col("expected"), "reported_findings": F.col("reported"), "true_positives": F.col("tp"), "false_positives": F.col("fp"), "false_negatives": F.col("fn"),
        "case_pass_rate": of("passed", "case_count"), "negative_case_pass_rate": of("negative_passed", "negative"), "stable_detection_rate": of("stable", "expectations"), "validation_rate": of("validated", "tp"),
        "attack_path_rate": of("attack_paths", "tp"), "code_evidence_rate": of("evidence", "tp"), "severity_accuracy": of("severity_ok", "judged"), "false_positives_per_run": of("fp", "run_count", 0.0),
    }
    one = one.select(*[made.get(m, F.col(m)).cast("double").alias(m) for m in METRICS])
    return one.unpivot([], METRICS, "metric", "value").withColumn("value", F.round("value", 9))


def eval_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_metrics(outcomes(spark, sf_dir))


def eval_run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_results(outcomes(spark, sf_dir))


def eval_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability(outcomes(spark, sf_dir))


def eval_case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_results(outcomes(spark, sf_dir))


def eval_negative_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of cases that expect nothing, and whether they passed: completed, with nothing reported wrongly."""
    runs = run_results(outcomes(spark, sf_dir)).where("expected = 0")
    return runs.select("case_id", "run", (F.col("completed") & (F.col("fp") == 0)).alias("passed"))


def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, before, after, delta, regressed) of two detectors by the metrics of the quality index."""
    before, after = (all_metrics(outcomes(spark, sf_dir, b)).select("metric", F.col("value").alias(n)) for b, n in ((1500, "before"), (2500, "after")))
    asked = F.broadcast(spark.createDataFrame([(m, up) for m, up, _ in QUALITY], "metric string, up boolean"))
    worse = F.when(F.col("up"), F.col("before") - F.col("after")).otherwise(F.col("after") - F.col("before"))
    both = before.join(after, "metric", "full_outer").join(asked, "metric")
    return both.select("metric", "before", "after", F.round(F.col("after") - F.col("before"), 9).alias("delta"), (F.round(worse, 9) > TOLERANCE).alias("regressed"))


def report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of two reports side by side; aligned is false where one lacks the case or expects something else."""
    columns = ["case_id", "expected", "runs", "tp", "fp", "fn", "passed"]
    a, b = (case_results(outcomes(spark, sf_dir, t)).select(*columns) for t in (1500, 2500))
    b = b.where("case_id <> 'src3'").toDF("case_id", *[f"{c}_after" for c in columns[1:]])
    both = a.join(b, "case_id", "full_outer")
    worse = (F.col("passed") & ~F.col("passed_after")) | (F.col("tp_after") < F.col("tp")) | (F.col("fp_after") > F.col("fp")) | (F.col("fn_after") > F.col("fn"))
    aligned = F.coalesce((F.col("expected") == F.col("expected_after")) & (F.col("runs") == F.col("runs_after")), F.lit(False))
    return both.select("case_id", "tp", "tp_after", "fp", "fp_after", "fn", "fn_after", aligned.alias("aligned"), F.coalesce(worse, F.lit(True)).alias("regressed"))


def quality_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted sum of a report's metrics, each within 0 and 1 and turned so that more is better, for both detectors."""
    weights = F.broadcast(spark.createDataFrame(QUALITY, "metric string, up boolean, weight double"))
    rows = None
    for name, base in (("before", 1500), ("after", 2500)):
        one = all_metrics(outcomes(spark, sf_dir, base)).join(weights, "metric")
        value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value")))
        one = one.agg(F.round(F.sum(F.col("weight") * F.when(F.col("up"), value).otherwise(1 - value)), 9).alias("quality")).select(F.lit(name).alias("report"), "quality")
        rows = one if rows is None else rows.unionAll(one)
    return rows


def _located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings of a year and of the year after, with weakness ids and line intervals, joined on target, year and path later."""
    loc = adjacent(spark, sf_dir).withColumn("cwe", F.array_distinct(F.array(F.col("finding_id") % 7, F.col("finding_id") % 5)))
    pick = lambda shift, n, k: loc.select("target_id", (F.col("yr") - shift).alias("yr"), "path", F.col("occurrence_id").alias(n), F.col("cwe").alias(f"cwe{k}"), F.col("start_line").alias(f"s{k}"), F.col("end_line").alias(f"e{k}"))
    return pick(0, "a", 0), pick(1, "b", 1)


def scored_pairs(spark: SparkSession, sf_dir: str, tolerance: int = 3) -> DataFrame:
    a, b = _located(spark, sf_dir)
    shared = F.size(F.array_intersect("cwe0", "cwe1"))
    pairs = matching.near_intervals(a, b, ["target_id", "yr", "path"], F.lit(tolerance)).withColumn("shared", shared)
    return pairs.where(F.col("shared") > 0).withColumn("score", 100 + 10 * F.col("shared") + 50 - F.col("gap"))


def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share a path and a weakness and lie near each other, with their score."""
    return scored_pairs(spark, sf_dir).select("a", "b", F.col("shared").cast("long").alias("shared"), "score")


def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _located(spark, sf_dir)
    return matching.near_intervals(a, b, ["target_id", "yr", "path"]).where("s0 <= e1 AND s1 <= e0").select("a", "b")


def shared_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of findings of one scan and path in consecutive years by weaknesses, joined on each one."""
    a, b = _located(spark, sf_dir)
    left, right = a.select("target_id", "yr", "path", "a", F.explode("cwe0").alias("cwe")), b.select("target_id", "yr", "path", "b", F.explode("cwe1").alias("cwe"))
    return left.join(right, ["target_id", "yr", "path", "cwe"]).groupBy("a", "b").agg(F.count("*").alias("shared"))


def max_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of a scan matched one to one with those of the next, as many as can be."""
    rows = scored_pairs(spark, sf_dir, tolerance=30).select("target_id", "yr", "a", "b", "score")
    return matching.matching(rows, ["target_id", "yr"])


QUERIES = {f.__name__: f for f in (eval_all_metrics, eval_run_results, eval_stability, eval_case_results, eval_negative_cases, report_metrics, report_cases, quality_index, match_scores, interval_overlaps, shared_weaknesses, max_matching)}


def _sql(base: int, s: str = "") -> str:
    """Common table expressions of one detector; s is a suffix of their names."""
    return f"""out{s} AS (
  SELECT coalesce(source, 'none') AS case_id, run, doc_id, c AS completed, toxic = 1 AS expected, c AND n_chars > {base} + 500 * run AS found, n_chars % 2 = 0 AS v, n_chars % 3 <> 0 AS p, n_chars % 5 <> 0 AS e, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 5 <> 0 END AS sv
  FROM (SELECT d.*, run, NOT coalesce(run = 2 AND TRY_CAST(regexp_extract(coalesce(source, 'none'), '([0-9]+)$', 1) AS INT) % 7 = 0, false) AS c FROM documents d, range(3) r(run)) JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)
), run{s} AS (SELECT case_id, run, bool_and(completed) AS completed, count(*) FILTER (expected) AS expected, count(*) FILTER (found) AS reported, count(*) FILTER (expected AND found) AS tp, count(*) FILTER (NOT expected AND found) AS fp,
    count(*) FILTER (expected AND NOT found) AS fn, count(*) FILTER (expected AND found AND v) AS validated, count(*) FILTER (expected AND found AND p) AS attack_paths, count(*) FILTER (expected AND found AND e) AS evidence,
    count(*) FILTER (expected AND found AND sv IS NOT NULL) AS judged, count(*) FILTER (expected AND found AND sv) AS severity_ok FROM out{s} GROUP BY 1, 2
), stab{s} AS (SELECT case_id, doc_id, CASE WHEN bool_and(found) THEN 'stable' WHEN bool_or(found) THEN 'unstable' ELSE 'missed' END AS state FROM out{s} WHERE expected GROUP BY 1, 2
), kase{s} AS (SELECT r.*, coalesce(stable, 0) AS stable, coalesce(unstable, 0) AS unstable FROM (SELECT case_id, max(expected) AS expected, count(*) AS runs, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, bool_and(completed AND fp = 0 AND fn = 0) AS passed FROM run{s} GROUP BY 1) r
    LEFT JOIN (SELECT case_id, count(*) FILTER (state = 'stable') AS stable, count(*) FILTER (state = 'unstable') AS unstable FROM stab{s} GROUP BY 1) USING (case_id)
), sums{s} AS (SELECT * FROM (SELECT count(*) AS n, count(*) FILTER (completed) AS done, count(*) FILTER (expected = 0) AS neg, count(*) FILTER (expected = 0 AND completed AND fp = 0) AS negok, sum(expected) AS x, sum(reported) AS rep, CAST(sum(tp) AS DOUBLE) AS tp, sum(fp) AS fp, sum(fn) AS fn,
    sum(validated) AS v, sum(attack_paths) AS ap, sum(evidence) AS ev, sum(judged) AS j, sum(severity_ok) AS so FROM run{s}), (SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, sum(expected) AS ex, sum(stable) AS st FROM kase{s})
), pr{s} AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM sums{s}
), wide{s} AS (SELECT cases AS case_count, n AS run_count, done AS completed_runs, CASE WHEN n = 0 THEN 1.0 ELSE done / n END AS completion_rate, x AS expected_instances, rep AS reported_findings, tp AS true_positives, fp AS false_positives, fn AS false_negatives, p AS precision, r AS recall,
    CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1, CASE WHEN cases = 0 THEN 1.0 ELSE passed / cases END AS case_pass_rate, CASE WHEN neg = 0 THEN 1.0 ELSE negok / neg END AS negative_case_pass_rate, CASE WHEN ex = 0 THEN 1.0 ELSE st / ex END AS stable_detection_rate,
    CASE WHEN tp = 0 THEN 1.0 ELSE v / tp END AS validation_rate, CASE WHEN tp = 0 THEN 1.0 ELSE ap / tp END AS attack_path_rate, CASE WHEN tp = 0 THEN 1.0 ELSE ev / tp END AS code_evidence_rate, CASE WHEN j = 0 THEN 1.0 ELSE so / j END AS severity_accuracy,
    CASE WHEN n = 0 THEN 0.0 ELSE fp / n END AS false_positives_per_run FROM pr{s}
), metric{s} AS (SELECT metric, round(value, 9) AS value FROM (SELECT {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)} FROM wide{s}) UNPIVOT (value FOR metric IN ({', '.join(METRICS)})))"""


_WEIGHTS = "weights AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {str(up).lower()}, {w})" for m, up, w in QUALITY) + ") t(metric, up, weight))"
_LOC = """c AS (SELECT *, list_distinct([finding_id % 7, finding_id % 5]) AS cwe FROM loc WHERE path IS NOT NULL), pair AS (
  SELECT a.occurrence_id AS a, b.occurrence_id AS b, len(list_intersect(a.cwe, b.cwe)) AS shared, greatest(0, a.start_line - b.end_line, b.start_line - a.end_line) AS gap
  FROM c a JOIN c b ON a.target_id = b.target_id AND b.yr = a.yr + 1 AND a.path = b.path)"""
ORACLES = {
    "eval_all_metrics": f"WITH {_sql(1500)} SELECT * FROM metric",
    "eval_run_results": f"WITH {_sql(1500)} SELECT * FROM run",
    "eval_stability": f"WITH {_sql(1500)} SELECT * FROM stab",
    "eval_case_results": f"WITH {_sql(1500)} SELECT * FROM kase",
    "eval_negative_cases": f"WITH {_sql(1500)} SELECT case_id, run, completed AND fp = 0 AS passed FROM run WHERE expected = 0",
    "report_metrics": f"WITH {_sql(1500)}, {_sql(2500, '2')}, {_WEIGHTS} SELECT metric, a.value AS before, b.value AS after, round(b.value - a.value, 9) AS delta, round(CASE WHEN up THEN a.value - b.value ELSE b.value - a.value END, 9) > 0.001 AS regressed FROM metric a JOIN metric2 b USING (metric) JOIN weights USING (metric)",
    "report_cases": f"""WITH {_sql(1500)}, {_sql(2500, '2')} SELECT coalesce(a.case_id, b.case_id) AS case_id, a.tp, b.tp AS tp_after, a.fp, b.fp AS fp_after, a.fn, b.fn AS fn_after, coalesce(a.expected = b.expected AND a.runs = b.runs, false) AS aligned,
      coalesce((a.passed AND NOT b.passed) OR b.tp < a.tp OR b.fp > a.fp OR b.fn > a.fn, true) AS regressed FROM kase a FULL JOIN (SELECT * FROM kase2 WHERE case_id <> 'src3') b ON a.case_id = b.case_id""",
    "quality_index": f"WITH {_sql(1500)}, {_sql(2500, '2')}, {_WEIGHTS}, q AS (SELECT 'before' AS report, * FROM metric UNION ALL SELECT 'after', * FROM metric2) SELECT report, round(sum(weight * CASE WHEN up THEN greatest(0, least(1, value)) ELSE 1 - greatest(0, least(1, value)) END), 9) AS quality FROM q JOIN weights USING (metric) GROUP BY 1",
    "match_scores": f"WITH {views.SQL}, {_LOC} SELECT a, b, shared, 150 + 10 * shared - gap AS score FROM pair WHERE gap <= 3 AND shared > 0",
    "interval_overlaps": f"WITH {views.SQL}, {_LOC} SELECT a, b FROM pair WHERE gap = 0",
    "shared_weaknesses": f"WITH {views.SQL}, {_LOC} SELECT a, b, shared FROM pair WHERE shared > 0",
}
