"""Queries that write tables as text formats to the shared folder and read them back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.session import shared_dir
from quarry.plans.views import table
from quarry.sources import files


def _written(rows: DataFrame, name: str, end: str = "\n", parts: int = 4) -> str:
    """The folder of rows (value) written as text."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.select("value").repartition(parts).write.option("lineSep", end).text(path)
    return path


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, every 20th followed by a blank line, every 50th broken off."""
    row = F.to_json(F.struct("event_id", "user_id", "event_type"))
    value = F.when(F.col("event_id") % 50 == 7, F.substring(row, 1, 20)).when(F.col("event_id") % 20 == 3, F.concat(row, F.lit("\n"))).otherwise(row)
    return table(spark, sf_dir, "events").select(value.alias("value"))


_EVENT = "event_id long, user_id long, event_type string"


def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines hold, are blank or are no JSON."""
    found = files.json_lines(spark, _written(_json(spark, sf_dir), "strict"), _EVENT)
    return found.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


def jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.json_lines(spark, _written(_json(spark, sf_dir), "lenient"), _EVENT, strict=False)
    return found.where("fault IS NULL").select("row.*")


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one file each, some with a byte order mark, some cut short; a file a brand."""
    one = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))
    text = F.to_json(F.struct(F.col("p_brand").alias("brand"), "parts"))
    text = F.when(F.col("p_brand").endswith("3"), F.concat(F.lit("﻿"), text)).when(F.col("p_brand").endswith("7"), F.substring(text, 1, 12)).otherwise(text)
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    one.select(F.col("p_brand").alias("brand"), text.alias("value")).repartition("brand").write.partitionBy("brand").option("lineSep", "\n").text(path)
    found = files.json_documents(spark, f"{path}/*", "brand string, parts array<long>")
    brand = F.try_url_decode(F.regexp_extract("path", r"brand=([^/]*)/", 1))
    return found.select(F.replace(F.try_url_decode(brand), F.lit("%23"), F.lit("#")).alias("file"), "doc.brand", F.size("doc.parts").cast("long").alias("parts"), "fault")


def csv_inventory_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of an inventory of suppliers: short rows, repeated ids, revisions that are no hash."""
    k = F.col("s_suppkey")
    sha = F.when(k % 7 == 2, F.lit("main")).otherwise(F.sha1("s_name"))
    name = F.when(k % 5 == 1, F.concat(F.lit("REPO-"), k - 1)).otherwise(F.concat(F.lit("repo-"), k))
    row = F.when(k % 11 == 4, F.concat_ws(",", name, F.lit("x"))).otherwise(F.concat_ws(",", name, F.lit('"Smith, ""J"""'), F.when(k % 2 == 0, F.upper(sha)).otherwise(sha)))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 3 == 0, F.concat(row, F.lit("\n  "))).otherwise(row).alias("value"))
    head = spark.createDataFrame([(-1, "id,owner,revision")], "s_suppkey long, value string")
    path = f"{shared_dir(spark)}/inventory-{uuid.uuid4().hex}"
    head.unionAll(rows).coalesce(1).sortWithinPartitions("s_suppkey").select("value").write.text(path)  # one file: an inventory is one
    _, faults = files.csv_inventory(spark, path, ["id", "owner", "revision"])
    return faults.groupBy("fault").agg(F.count("*").alias("n"))


def receipt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last receipts of ledgers, one file each, whose last line is torn: it has no line feed.

    A ledger is sorted and written line by line, each line after the line feed before it; what ends
    a row for the writer is the brace that ends its JSON.
    """
    k = F.col("o_custkey") % 40
    name = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("Task-")).otherwise(F.lit("task-")), k)
    row = F.to_json(F.struct(name.alias("id"), F.col("o_orderstatus").alias("status")))
    rows = table(spark, sf_dir, "orders").select((k % 8).alias("ledger"), F.lit(0).alias("torn"), F.col("o_orderkey").alias("at"), row.alias("j"))
    torn = rows.select("ledger").distinct().select("ledger", F.lit(1).alias("torn"), F.lit(0).cast("long").alias("at"), F.lit('{"id":"task-1","status":"TORN"}').alias("j"))
    path = f"{shared_dir(spark)}/ledgers-{uuid.uuid4().hex}"
    sorted_rows = rows.unionAll(torn).repartition("ledger").sortWithinPartitions("ledger", "torn", "at", "j")
    sorted_rows.select("ledger", F.concat(F.lit("\n"), F.substring("j", F.lit(1), F.length("j") - 1)).alias("value")).write.partitionBy("ledger").option("lineSep", "}").text(path)
    return files.receipts(spark, f"{path}/*", "id string, status string", "id").select(F.col("receipt").alias("id"), "status")


def recursive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files below a tree of folders, by folder."""
    path = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") % 3).alias("k"), F.concat_ws(":", "conv_id", "turn").alias("value")).write.partitionBy("role", "k").option("lineSep", "\n").text(path)
    found = files.lines(spark, path, recursive=True, pattern="*.txt")
    return found.groupBy(F.regexp_extract("path", "role=([^/]*)/", 1).alias("role"), F.regexp_extract("path", "k=([^/]*)/", 1).cast("long").alias("k")).agg(F.count("*").alias("n"))


def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which made-up paths a file inventory leaves out: by folder, but for Java packages, and by suffix."""
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, F.concat_ws("/", F.lit("node_modules"), "p_brand", F.lit("a.js"))).when(k == 1, F.concat_ws("/", F.lit("src/main/java/build"), "p_type", F.lit("A.java")))
    path = path.when(k == 2, F.concat_ws("/", "p_brand", F.lit("a.min.js"))).when(k == 3, F.concat_ws("/", "p_brand", F.lit("build/a.py"))).otherwise(F.concat_ws("/", "p_brand", F.lit("build.py")))
    path = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("node_modules/x/src/main/java/"), path)).otherwise(path)
    return table(spark, sf_dir, "part").select("p_partkey", T.is_excluded(path, ["node_modules", "build", "dist"], [".min.js", ".map"], packages=["build"]).alias("excluded"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a tree that a code inventory keeps, by folder."""
    path = f"{shared_dir(spark)}/code-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), F.col("p_partkey") % 4).alias("d"), F.when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit("\0"))).otherwise(F.col("p_name")).alias("value"))
    rows.repartition("d").write.partitionBy("d").option("lineSep", "\n").text(path)
    found = files.repository_files(spark, path, F.col("path").contains("/d=d2/"), [".txt"])
    return found.groupBy(F.regexp_extract("path", "d=([^/]*)/", 1).alias("folder")).agg(F.sum("bytes").alias("bytes"))


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged and unstaged changes as one list: of a path in both, the unstaged one counts; a list a brand."""
    part = table(spark, sf_dir, "part")
    one = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("R100\0old"), "p_partkey", F.lit("\0p"), "p_partkey", F.lit("\0"))).otherwise(F.concat(F.when(F.col("p_partkey") % 3 == 0, "D").otherwise("M"), F.lit("\0p"), "p_partkey", F.lit("\0")))
    lists = [files.name_status(part.where(cond).groupBy("p_brand").agg(F.array_join(F.collect_list(one), "").alias("z"))) for cond in ("p_partkey % 2 = 0", "p_partkey % 5 = 0")]
    staged, unstaged = lists[0].withColumnRenamed("status", "s"), lists[1].select("path", F.lit("A").alias("u"))
    return staged.join(unstaged, "path", "full_outer").select("path", F.coalesce("u", "s").alias("status"))


#: Parts, by their numbers, whose results share SARIF documents: a document is one value and may not grow with the table.
DOCUMENT_PARTS = 25_000


def _sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc): SARIF documents of a brand each, made of its parts and read through JSON; a path is brand/number."""
    k = F.col("p_partkey")
    result = F.struct(
        F.when(k % 3 != 0, F.concat(F.lit("r"), k % 4)).alias("ruleId"), F.when(k % 3 == 0, (k % 4).cast("int")).alias("ruleIndex"), F.when(k % 2 == 0, "error").otherwise("note").alias("level"),
        F.when(k % 13 == 5, "pass").alias("kind"), F.when(k % 17 == 3, "absent").alias("baselineState"), F.struct(F.col("p_name").alias("text")).alias("message"),
        F.when(k % 5 == 0, F.struct(F.concat(k % 11, F.lit(".000")).alias("security-severity"))).alias("properties"), F.when(k % 7 == 1, F.array(F.struct(F.when(k % 2 == 0, "rejected").alias("status")))).alias("suppressions"),
        F.array(F.struct(F.struct(F.struct(F.concat_ws("/", "p_type", "p_partkey").alias("uri")).alias("artifactLocation"), F.struct((k % 90 + 1).cast("int").alias("startLine"), F.when(k % 2 == 1, (k % 90 + 4).cast("int")).alias("endLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    rules = F.array(*[F.struct(F.lit(f"r{i}").alias("id"), F.lit(f"rule {i}").alias("name")) for i in range(4)])
    runs = table(spark, sf_dir, "part").groupBy("p_brand", F.coalesce(F.floor(k / DOCUMENT_PARTS), F.lit(-1)).alias("number")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.to_json(result).alias("j")))).alias("l"))
    text = F.concat(F.lit('{"runs":[{"tool":{"driver":{"rules":'), F.to_json(rules), F.lit('}},"results":['), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]}]}"))
    return runs.select(F.concat("p_brand", F.lit("/"), "number").alias("path"), F.from_json(text, files.SARIF).alias("doc"))


def _brand() -> Column:
    return F.regexp_replace("path", "/[^/]*$", "")


def sarif_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.sarif_results(_sarif(spark, sf_dir))
    return found.select(_brand().alias("brand"), "rule_id", "rule", "severity", "uri", "start_line", "end_line")


def sarif_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and where they came from, as the lines of two files: written, and read back."""
    found = files.sarif_results(_sarif(spark, sf_dir)).withColumn("candidate", F.sha2(F.concat_ws("|", "path", "rule_id", "uri", "start_line"), 256))
    path = f"{shared_dir(spark)}/seeds-{uuid.uuid4().hex}"
    found.select("candidate", "rule_id", "uri", "start_line").write.json(f"{path}/candidates")
    found.select("candidate", _brand().alias("source")).write.json(f"{path}/sources")
    a, b = spark.read.schema("candidate string, rule_id string, uri string, start_line long").json(f"{path}/candidates"), spark.read.schema("candidate string, source string").json(f"{path}/sources")
    return a.join(b, "candidate").select("rule_id", "uri", "start_line", "source")


QUERIES = {f.__name__: f for f in (jsonl_strict, jsonl_lenient, json_document, csv_inventory_faults, receipt_ledger, recursive_files, excluded_paths, source_files, changed_paths, sarif_locations, sarif_seeds)}
_SARIF = """k AS (SELECT *, p_partkey AS k FROM part WHERE p_partkey % 13 <> 5 AND p_partkey % 17 <> 3 AND NOT (p_partkey % 7 = 1 AND p_partkey % 2 <> 0)), loc AS (SELECT p_brand AS brand, 'r' || k % 4 AS rule_id, 'rule ' || k % 4 AS rule,
  CASE WHEN k % 5 = 0 AND k % 11 > 0 THEN CASE WHEN k % 11 > 9 THEN 'critical' WHEN k % 11 >= 7 THEN 'high' WHEN k % 11 >= 4 THEN 'medium' ELSE 'low' END WHEN k % 2 = 0 THEN 'high' ELSE 'low' END AS severity, p_type || '/' || k AS uri, k % 90 + 1 AS start_line, CASE WHEN k % 2 = 1 THEN k % 90 + 4 ELSE k % 90 + 1 END AS end_line FROM k)"""
ORACLES = {
    "jsonl_strict": "SELECT CASE WHEN event_id % 50 = 7 THEN 'not JSON' ELSE 'none' END AS fault, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'blank line', count(*) FROM events WHERE event_id % 20 = 3 AND event_id % 50 <> 7 HAVING count(*) > 0",
    "jsonl_lenient": "SELECT event_id, user_id, event_type FROM events WHERE event_id % 50 <> 7",
    "json_document": "SELECT p_brand AS file, CASE WHEN NOT ends_with(p_brand, '7') THEN p_brand END AS brand, CASE WHEN NOT ends_with(p_brand, '7') THEN count(*) END AS parts, CASE WHEN ends_with(p_brand, '7') THEN 'not JSON' END AS fault FROM part GROUP BY 1",
    "csv_inventory_faults": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 1 THEN s_suppkey - 1 ELSE s_suppkey END AS i FROM supplier), f AS (SELECT CASE WHEN k % 11 = 4 THEN 'width' WHEN k % 7 = 2 THEN 'revision' END AS fault FROM s UNION ALL SELECT 'repeated id' FROM s WHERE i IN (SELECT i FROM s GROUP BY 1 HAVING count(*) > 1))
      SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1""",
    "receipt_ledger": "SELECT 'task-' || o_custkey % 40 AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1",
    "recursive_files": "SELECT role, conv_id % 3 AS k, count(*) AS n FROM conversations GROUP BY 1, 2",
    "excluded_paths": "SELECT p_partkey, p_partkey % 5 IN (0, 2, 3) OR p_partkey % 7 = 0 AS excluded FROM part",
    "source_files": "SELECT 'd' || p_partkey % 4 AS folder, CAST(sum(length(p_name) + 1) AS BIGINT) AS bytes FROM part WHERE p_partkey % 4 IN (0, 3) GROUP BY 1",
    "changed_paths": "SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'A' WHEN p_partkey % 4 = 0 THEN 'R' WHEN p_partkey % 3 = 0 THEN 'D' ELSE 'M' END AS status FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 = 0",
    "sarif_locations": f"WITH {_SARIF} SELECT * FROM loc",
    "sarif_seeds": f"WITH {_SARIF} SELECT rule_id, uri, start_line, brand AS source FROM loc",
}
