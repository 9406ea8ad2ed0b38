"""Sets of rows by owner that are replaced as wholes in a shared table, and decisions that are added only where they change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans import views
from quarry.plans.session import shared_dir

#: Column that tells rows from the mark of an owner that was written.
THERE = "_there"


def replace_sets(path: str, owners: DataFrame, rows: DataFrame, owner: str, groups: int, files: int = 8) -> None:
    """Replaces all rows of the given owners in the table at `path` by `rows`; other owners stay as they are.

    owners has a column `owner` (repeats count once); rows of owners that it does not name are left
    out, and an owner without rows is emptied. Null owners are left out. Each owner is a folder of
    the table, dealt to up to `files` tasks, as one owner may hold a third of all rows; `groups` is
    the number of tasks of all. Dynamic overwrite stages all new files first and moves them in at
    the commit: a job that fails changes nothing, and one that is run again gives the same table.
    Rows must not be read from the table itself.
    """
    spark = rows.sparkSession
    named = owners.select(owner).where(F.col(owner).isNotNull()).distinct()
    kept = rows.join(named, owner, "left_semi").withColumn(THERE, F.lit(True))
    marks = named.withColumn(THERE, F.lit(False))
    every = kept.unionByName(marks, allowMissingColumns=True)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
    dealt = every.repartition(groups, F.col(owner), salt)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)
    spark.catalog.refreshByPath(path)


def read_sets(spark: SparkSession, path: str, owner: str, owner_type: str) -> DataFrame:
    """The rows of a table of sets, with their owner; owners without rows have none."""
    rows = spark.read.option("basePath", path).parquet(path).where(THERE).drop(THERE)
    return rows.withColumn(owner, F.col(owner).cast(owner_type))


def changed_decisions(known: DataFrame, given: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """The decisions among `given` that are to be appended: those that differ from the one before them of the same keys.

    Before stands the latest known decision of the keys, then the given ones in order (total within
    keys). Nulls are values: a change to or from null is one. A decision given twice is appended once.
    """
    latest = known.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"), F.max(F.struct(*order)).alias("_at"))
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = given.withColumn("_v", F.struct(*values)).withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag("_v").over(w))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_g.{k}").eqNullSafe(F.col(f"_h.{k}"))
    both = steps.alias("_g").join(latest.alias("_h"), same, "left")
    first = F.col("_n") == 1
    before = F.when(first, F.col("_last")).otherwise(F.col("_before"))
    changed = F.when(first & F.col("_last").isNull(), F.lit(True)).otherwise(~F.col("_v").eqNullSafe(before))
    return both.where(changed).select(*[F.col(f"_g.{c}").alias(c) for c in given.columns])


def replaced_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by year after every third year was written anew: its criticals alone; every fifth year is emptied. The table is written, replaced and read."""
    occ = views.occurrences(spark, sf_dir).select("yr", "occurrence_id", "sev")
    path = f"{shared_dir(spark)}/sets/{uuid.uuid4().hex}"
    owners = occ.select("yr").distinct()
    replace_sets(path, owners, occ.withColumn("source", F.lit("old")), "yr", 16)
    again = owners.where("yr % 3 = 0 OR yr % 5 = 0")
    replace_sets(path, again, occ.where("yr % 3 = 0 AND yr % 5 <> 0 AND sev <= 1").withColumn("source", F.lit("new")), "yr", 16)
    return read_sets(spark, path, "yr", "long").select("yr", "occurrence_id", "sev", "source")


def triage_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage decisions that the years from 1995 on add to those known before."""
    rows = views.occurrences(spark, sf_dir).select("target_id", "finding_id", "yr", F.coalesce("triage", F.lit("open")).alias("status"), "reason")
    return changed_decisions(rows.where("yr < 1995"), rows.where("yr >= 1995"), ["target_id", "finding_id"], ["status", "reason"], ["yr"])


QUERIES = {f.__name__: f for f in (replaced_scans, triage_appends)}
ORACLES = {
    "replaced_scans": f"WITH {views.SQL} SELECT yr, occurrence_id, sev, CASE WHEN yr % 3 = 0 THEN 'new' ELSE 'old' END AS source FROM occ WHERE yr % 5 <> 0 AND (yr % 3 <> 0 OR sev <= 1)",
    "triage_appends": f"""WITH {views.SQL}, d AS (SELECT target_id, finding_id, yr, coalesce(triage, 'open') AS status, reason FROM occ),
      s AS (SELECT *, lag(status) OVER w AS ws, lag(reason) OVER w AS wr FROM d WINDOW w AS (PARTITION BY target_id, finding_id ORDER BY yr))
      SELECT target_id, finding_id, yr, status, reason FROM s WHERE yr >= 1995 AND (ws IS NULL OR ws <> status OR wr IS DISTINCT FROM reason)""",
}
