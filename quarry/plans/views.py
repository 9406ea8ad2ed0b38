"""Domain views over the star-schema tables: scans, occurrences of findings, locations and sessions.

Scan ids are supplier and year of shipping; a finding is a part number modulo 40. Every view is
a projection or one aggregation with map-side minima, so that the optimizer prunes and pushes
down through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severity names by rank, strongest first.
SEVERITIES = ["critical", "high", "medium", "low", "informational"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def severity_name(rank: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col(rank) if isinstance(rank, str) else rank) + 1)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports of findings, repeats included."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END AS sev",
    )
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_suppkey AS target_id", "CAST(year(l_shipdate) AS BIGINT) AS yr", "l_partkey AS part", "CAST(l_linenumber AS BIGINT) AS line", "l_returnflag AS flag"
    )
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).selectExpr(
        "target_id", "yr", "target_id * 10000 + yr AS scan_id", "part % 40 AS finding_id", "sev", "l_orderkey AS seq", "part", "line", "flag"
    )


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a scan and finding: the strongest report, then the earliest."""
    first = F.min(F.struct("sev", "seq", "part", "line", "flag")).alias("k")
    best = findings(spark, sf_dir).groupBy("target_id", "yr", "finding_id").agg(first).withColumn("scan_id", F.expr("target_id * 10000 + yr"))
    return best.selectExpr(
        "scan_id", "target_id", "yr", "finding_id", "scan_id * 100 + finding_id AS occurrence_id", "k.sev AS sev", "k.seq AS seq", "k.part AS part", "k.line AS line",
        "CASE k.flag WHEN 'A' THEN 'open' WHEN 'R' THEN 'closed' END AS triage",
        "CASE WHEN k.flag = 'R' THEN CASE WHEN k.line % 2 = 1 THEN 'already_fixed' ELSE 'false_positive' END END AS reason",
    )


def located(occ: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences with the path and lines of their primary location."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand AS brand", "concat(p_brand, '/', p_type, '/', p_partkey) AS path", "CAST(p_size AS BIGINT) AS size")
    return occ.join(part, occ["part"] == part["p_partkey"], "left").drop("p_partkey").withColumn("start_line", F.col("line") * 10).withColumn("end_line", F.col("line") * 10 + F.col("size"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, target_id, yr, complete, excluded): excluded is the brand folder left out of a scan."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS target_id", "CAST(year(l_shipdate) AS BIGINT) AS yr").distinct()
    return rows.selectExpr("target_id * 10000 + yr AS scan_id", "target_id", "yr", "(target_id + yr) % 5 <> 0 AS complete", "concat('Brand#', (target_id + yr) % 25 + 1) AS excluded")


#: The same views for DuckDB, as common table expressions.
SQL = """
li AS (
  SELECT l_suppkey AS target_id, CAST(year(l_shipdate) AS BIGINT) AS yr, l_suppkey * 10000 + year(l_shipdate) AS scan_id, l_partkey % 40 AS finding_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END AS sev,
    l_orderkey AS seq, l_partkey AS part, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), occ AS (
  SELECT scan_id, target_id, yr, finding_id, scan_id * 100 + finding_id AS occurrence_id, sev, seq, part, line,
    CASE flag WHEN 'A' THEN 'open' WHEN 'R' THEN 'closed' END AS triage,
    CASE WHEN flag = 'R' THEN CASE WHEN line % 2 = 1 THEN 'already_fixed' ELSE 'false_positive' END END AS reason
  FROM li QUALIFY row_number() OVER (PARTITION BY scan_id, finding_id ORDER BY sev, seq, part, line, flag) = 1
), loc AS (
  SELECT occ.*, p_brand AS brand, p_brand || '/' || p_type || '/' || p_partkey AS path, CAST(p_size AS BIGINT) AS size, line * 10 AS start_line, line * 10 + p_size AS end_line
  FROM occ LEFT JOIN part ON part = p_partkey
), scans AS (
  SELECT DISTINCT l_suppkey * 10000 + year(l_shipdate) AS scan_id, l_suppkey AS target_id, CAST(year(l_shipdate) AS BIGINT) AS yr,
    (l_suppkey + year(l_shipdate)) % 5 <> 0 AS complete, 'Brand#' || ((l_suppkey + year(l_shipdate)) % 25 + 1) AS excluded FROM lineitem
), names AS (SELECT * FROM (VALUES (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'low'), (4, 'informational')) AS t(rank, severity))
"""
