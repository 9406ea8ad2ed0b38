"""Comparing two scans of a target: what is new, persisting, reopened, resolved or unknown.

Occurrences meet only through saved match groups, each of some earlier and some later occurrences;
what no group holds stands alone. A group is reopened if any of its earlier ones was closed as fixed
and any of its later ones is open. What the later scan lacks is resolved only if that scan was
complete and covers the path; what a scan is unsure of stays unknown.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import views
from quarry.plans.session import shared_dir

#: Fixed: all statuses, in the order of the summary.
STATUSES = ["new", "persisting", "resolved", "reopened", "unknown"]


def covers(path: Column, complete: Column, includes: Column, excludes: Column, explicit: Column) -> Column:
    """Whether a scan looked at a path: it was complete, includes it, and no exclusion holds it or fits it as a shell pattern.

    Unknown paths are not covered, and a scan whose lists are not known covers nothing.
    """
    known = includes.isNotNull() & excludes.isNotNull() & explicit.isNotNull()
    any_of = lambda rule, scopes: F.exists(scopes, lambda s: F.coalesce(rule(path, s), F.lit(False)))
    return F.coalesce(known & complete & (path != "") & any_of(T.within, includes) & ~any_of(T.matches, excludes) & ~any_of(T.matches, explicit), F.lit(False))


def classify(before: DataFrame, after: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Status of every match group and every lone occurrence of every pair of scans.

    before and after have (scan_id, occurrence_id, finding_id, sev, triage, reason, path, unsure); pairs
    has (before_scan, after_scan, target_id, complete, includes, excludes, explicit) of the later
    scan; groups has (before_scan, after_scan, side, occurrence_id, group_id). A row's severity and
    path are of its strongest later occurrence, else of its first earlier one.
    """
    row = F.struct("occurrence_id", "finding_id", "sev", "path")
    rows = None
    for side, occ in (("before", before), ("after", after)):
        keyed = pairs.select("before_scan", "after_scan").join(occ.withColumnRenamed("scan_id", f"{side}_scan"), f"{side}_scan")
        keyed = keyed.select("before_scan", "after_scan", F.lit(side).alias("side"), "occurrence_id", row.alias("row"), "sev", F.coalesce("triage", F.lit("open")).alias("triage"), "reason", "unsure")
        rows = keyed if rows is None else rows.unionAll(keyed)
    placed = rows.join(groups, ["before_scan", "after_scan", "side", "occurrence_id"], "left")
    name = F.coalesce(F.concat(F.lit("group "), "group_id"), F.concat_ws(" ", "side", "occurrence_id"))
    earlier, later = F.col("side") == "before", F.col("side") == "after"
    fixed = earlier & (F.col("triage") == "closed") & (F.col("reason") == "already_fixed")
    every = placed.groupBy("before_scan", "after_scan", name.alias("unit")).agg(
        F.min(F.when(earlier, F.struct("occurrence_id", "row"))).alias("old"), F.min(F.when(later, F.struct("sev", "occurrence_id", "row"))).alias("new"),
        F.bool_or(F.coalesce(fixed, F.lit(False))).alias("fixed"), F.bool_or(later & (F.col("triage") == "open")).alias("open"), F.bool_or("unsure").alias("unsure"),
        F.count_if(earlier).alias("n_before"), F.count_if(later).alias("n_after"),
    )
    every = every.join(pairs, ["before_scan", "after_scan"])
    status = (
        F.when(F.col("old").isNull(), F.when(F.col("unsure"), "unknown").otherwise("new"))
        .when(F.col("new").isNotNull(), F.when(F.col("fixed") & F.col("open"), "reopened").otherwise("persisting"))
        .when(F.col("unsure") | ~covers(F.col("old.row.path"), *[F.col(c) for c in ("complete", "includes", "excludes", "explicit")]), "unknown")
        .otherwise("resolved")
    )
    chosen = F.coalesce("new.row", "old.row")
    return every.select(
        "target_id", "before_scan", "after_scan", chosen["finding_id"].alias("finding_id"), chosen["occurrence_id"].alias("occurrence_id"), status.alias("status"),
        views.severity_name(chosen["sev"]).alias("severity"), chosen["path"].alias("path"), "n_before", "n_after",
    )


def coverage(scans: DataFrame) -> DataFrame:
    """scans with the paths that they include, exclude and were told to leave out: brand folders of every fourth scan, else everything."""
    brands = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: F.concat(F.lit("Brand#"), k))
    some = F.filter(brands, lambda b: F.length(b) == 8)
    includes = F.when((F.col("target_id") + F.col("yr")) % 4 == 0, some).otherwise(F.array(F.lit(".")))
    explicit = F.array(F.concat(F.lit("Brand#"), (F.col("yr") % 25 + 1), F.lit("/ECONOMY*ED ?*")))
    return scans.withColumn("includes", includes).withColumn("excludes", F.array("excluded")).withColumn("explicit", explicit)


def consecutive(scans: DataFrame) -> DataFrame:
    later = coverage(scans).select("target_id", (F.col("yr") - 1).alias("yr"), F.col("scan_id").alias("after_scan"), "complete", "includes", "excludes", "explicit")
    return scans.select("target_id", "yr", F.col("scan_id").alias("before_scan")).join(later, ["target_id", "yr"]).drop("yr")


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences with their paths, joined once into the shared folder: a comparison reads them four times, with other columns each."""
    loc = views.located(views.occurrences(spark, sf_dir), spark, sf_dir)
    place = f"{shared_dir(spark)}/occurrences-{uuid.uuid4().hex}"
    loc.select("scan_id", "target_id", "occurrence_id", "finding_id", "sev", "triage", "reason", "path", (F.col("occurrence_id") % 17 == 0).alias("unsure")).write.parquet(place)
    return spark.read.parquet(place)


def match_groups(occ: DataFrame, pairs: DataFrame) -> DataFrame:
    """Saved groups: findings 2 k and 2 k + 1 of both scans, where both have one; every fifth is not saved."""
    sides = []
    for side in ("before", "after"):
        keyed = pairs.select("before_scan", "after_scan").join(occ.withColumnRenamed("scan_id", f"{side}_scan"), f"{side}_scan")
        sides.append(keyed.select("before_scan", "after_scan", "target_id", F.lit(side).alias("side"), "occurrence_id", F.expr("finding_id div 2").alias("group_id")))
    whole = sides[0].unionAll(sides[1]).where((F.col("group_id") + F.col("target_id")) % 5 != 0)
    keys = ["before_scan", "after_scan", "group_id"]
    both = whole.groupBy(*keys).agg(F.count_if(F.col("side") == "before").alias("b"), F.count_if(F.col("side") == "after").alias("a")).where("a > 0 AND b > 0")
    return whole.join(both, keys).select(*keys, "side", "occurrence_id")


def compare_status_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ, pairs = _occurrences(spark, sf_dir), consecutive(views.scans(spark, sf_dir))
    found = classify(occ.drop("target_id"), occ.drop("target_id"), pairs, match_groups(occ, pairs))
    return found.select("target_id", "before_scan", "after_scan", "finding_id", "occurrence_id", "status", "severity", "path", "n_before", "n_after")


def compare_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all statuses for each pair of scans, zeros included."""
    rows = compare_status_by_target(spark, sf_dir)
    counts = rows.groupBy("before_scan", "after_scan").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return counts.select("before_scan", "after_scan", F.expr("stack(5, " + ", ".join(f"'{s}', {s}" for s in STATUSES) + ") AS (status, n)"))


def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved matches of each pair of scans: earlier times later ones, over its groups."""
    occ, pairs = _occurrences(spark, sf_dir), consecutive(views.scans(spark, sf_dir))
    sides = match_groups(occ, pairs).groupBy("before_scan", "after_scan", "group_id").agg(F.count_if(F.col("side") == "before").alias("b"), F.count_if(F.col("side") == "after").alias("a"))
    return sides.groupBy("before_scan", "after_scan").agg(F.count("*").alias("groups"), F.sum(F.col("b") * F.col("a")).alias("matches"))


def group_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a matcher's answer does wrong: occurrences in two groups, and ids that the scan does not have."""
    occ, pairs = _occurrences(spark, sf_dir), consecutive(views.scans(spark, sf_dir))
    good = match_groups(occ, pairs).where("side = 'before'").select("before_scan", "group_id", "occurrence_id")
    twice = good.where("occurrence_id % 29 = 0").withColumn("group_id", F.col("group_id") + 1)
    strange = good.where("occurrence_id % 31 = 0").withColumn("occurrence_id", F.col("occurrence_id") + 10**9)
    answer = good.unionAll(twice).unionAll(strange)
    known = occ.select(F.col("scan_id").alias("before_scan"), "occurrence_id")
    shared = answer.groupBy("before_scan", "occurrence_id").agg(F.count_distinct("group_id").alias("n")).where("n > 1").select("before_scan", "occurrence_id", F.lit("in two groups").alias("fault"))
    unknown = answer.join(known, ["before_scan", "occurrence_id"], "left_anti").select("before_scan", "occurrence_id", F.lit("unknown").alias("fault")).distinct()
    return shared.unionAll(unknown)


COMPARE_SQL = f"""WITH {views.SQL}, cov AS (
  SELECT *, CASE WHEN (target_id + yr) % 4 = 0 THEN list_transform(range(10, 26), lambda k: 'Brand#' || k) ELSE ['.'] END AS includes, [excluded] AS excludes, ['Brand#' || (yr % 25 + 1) || '/ECONOMY*ED ?*'] AS explicit FROM scans
), pair AS (SELECT a.target_id, a.scan_id AS before_scan, b.scan_id AS after_scan, b.complete, b.includes, b.excludes, b.explicit FROM scans a JOIN cov b ON a.target_id = b.target_id AND b.yr = a.yr + 1
), side AS (
  SELECT p.before_scan, p.after_scan, 'before' AS side, l.* FROM pair p JOIN loc l ON l.scan_id = p.before_scan UNION ALL
  SELECT p.before_scan, p.after_scan, 'after' AS side, l.* FROM pair p JOIN loc l ON l.scan_id = p.after_scan
), saved AS (SELECT before_scan, after_scan, finding_id // 2 AS g, count(*) FILTER (side = 'before') AS b, count(*) FILTER (side = 'after') AS a FROM side WHERE (finding_id // 2 + target_id) % 5 <> 0 GROUP BY 1, 2, 3 HAVING a > 0 AND b > 0
), unit AS (SELECT side.*, CASE WHEN saved.g IS NULL THEN side || ' ' || occurrence_id ELSE 'group ' || saved.g END AS u, coalesce(triage, 'open') AS t FROM side LEFT JOIN saved ON side.before_scan = saved.before_scan AND side.after_scan = saved.after_scan AND side.finding_id // 2 = saved.g
), chosen AS (SELECT * FROM unit QUALIFY row_number() OVER (PARTITION BY before_scan, after_scan, u ORDER BY CASE side WHEN 'after' THEN 0 ELSE 1 END, CASE WHEN side = 'after' THEN sev END, occurrence_id) = 1
), facts AS (SELECT before_scan, after_scan, u, count(*) FILTER (side = 'before') AS n_before, count(*) FILTER (side = 'after') AS n_after, bool_or(occurrence_id % 17 = 0) AS unsure,
    bool_or(side = 'before' AND t = 'closed' AND coalesce(reason, '') = 'already_fixed') AS fixed, bool_or(side = 'after' AND t = 'open') AS open FROM unit GROUP BY 1, 2, 3
), status AS (
  SELECT p.target_id, before_scan, after_scan, finding_id, occurrence_id,
    CASE WHEN n_before = 0 THEN CASE WHEN unsure THEN 'unknown' ELSE 'new' END WHEN n_after > 0 THEN CASE WHEN fixed AND open THEN 'reopened' ELSE 'persisting' END WHEN unsure THEN 'unknown'
      WHEN path IS NULL OR NOT complete OR NOT (includes = ['.'] OR list_contains(includes, brand)) OR list_contains(excludes, brand) OR regexp_matches(path, '^' || replace(replace(explicit[1], '?', '.'), '*', '.*') || '$') THEN 'unknown' ELSE 'resolved' END AS status,
    severity, path, n_before, n_after
  FROM chosen JOIN facts USING (before_scan, after_scan, u) JOIN pair p USING (before_scan, after_scan) JOIN names ON rank = sev
)"""

QUERIES = {f.__name__: f for f in (compare_status_by_target, compare_status_summary, match_count, group_conflicts)}
ORACLES = {
    "compare_status_by_target": f"{COMPARE_SQL} SELECT * FROM status",
    "compare_status_summary": f"""{COMPARE_SQL} SELECT p.before_scan, p.after_scan, s.status, count(status.finding_id) AS n
      FROM (SELECT DISTINCT before_scan, after_scan FROM status) p CROSS JOIN (VALUES ('new'), ('persisting'), ('resolved'), ('reopened'), ('unknown')) s(status)
      LEFT JOIN status ON status.before_scan = p.before_scan AND status.after_scan = p.after_scan AND status.status = s.status GROUP BY 1, 2, 3""",
    "match_count": f"{COMPARE_SQL} SELECT before_scan, after_scan, count(*) AS groups, CAST(sum(a * b) AS BIGINT) AS matches FROM saved GROUP BY 1, 2",
    "group_conflicts": f"""{COMPARE_SQL}, good AS (SELECT before_scan, g, occurrence_id FROM side JOIN saved USING (before_scan, after_scan) WHERE side = 'before' AND finding_id // 2 = g)
      SELECT before_scan, occurrence_id, 'in two groups' AS fault FROM good WHERE occurrence_id % 29 = 0 UNION ALL SELECT DISTINCT before_scan, occurrence_id + 1000000000, 'unknown' FROM good WHERE occurrence_id % 31 = 0""",
}
