"""Readers of text formats as DataFrames: rows that hold, and beside them what is wrong with the others.

All take a path that Spark reads. Lines are read by splits; a JSON document is one value of one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Files that Spark reads uncompressed; their sizes say nothing of their lines.
_PACKED = r"\.(?:gz|bz2|deflate|zst|lz4|snappy)$"


def _whole_lines(files: DataFrame) -> DataFrame:
    """(path, line, text, last) of files (path, value), each one value."""
    ends = F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))
    each = files.select("path", ends.alias("ends"), F.split("value", "\n").alias("parts")).select("path", "ends", F.posexplode("parts").alias("at", "text"))
    return each.where("at < ends OR text <> ''").select("path", (F.col("at") + 1).cast("long").alias("line"), "text", (F.col("at") == F.col("ends")).alias("last"))


def lines(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, line, text, last): the lines of each file from 1; last is the text after the final line feed, where there is any.

    A file is read by as many tasks as it has splits. A line's number is its place in its split and
    the lines of the splits before, which are counted first; a file of more bytes than its lines and
    their line feeds ends with one. Compressed files cannot be split; each is one value of one task.
    A byte order mark at the start of a file that is not compressed is no text.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.text(path, lineSep="\n")
    read = files.where(~F.col("_metadata.file_name").rlike(_PACKED)).select(
        F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_size").alias("_size"), F.col("value").alias("text")
    )
    splits = read.groupBy("path", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum(F.octet_length("text").cast("long") + 1).alias("_bytes"), F.max("_size").alias("_size"))
    file = Window.partitionBy("path")
    before = F.sum("_n").over(file.orderBy("_split")) - F.col("_n")
    over = F.sum("_bytes").over(file) - F.col("_size")  # one line feed more than there is; three bytes less with a byte order mark
    splits = splits.select("path", "_split", (before + 1 - F.col("_first")).alias("_shift"), F.when(over.isin(1, -2), F.sum("_n").over(file)).alias("_open"))
    each = read.join(splits, ["path", "_split"]).withColumn("line", F.col("_at") + F.col("_shift"))
    each = each.select("path", "line", "text", F.coalesce(F.col("line") == F.col("_open"), F.lit(False)).alias("last"))
    if any(re.search(_PACKED, f) for f in files.inputFiles()):
        packed = reader.text(path, wholetext=True).where(F.col("_metadata.file_name").rlike(_PACKED))
        each = each.unionAll(_whole_lines(packed.select(F.input_file_name().alias("path"), "value")))
    return each.withColumn("text", F.regexp_replace("text", "\r$", ""))


def json_documents(spark: SparkSession, path: str, schema: str, most: int = 16 << 20, pattern: str | None = None) -> DataFrame:
    """(path, doc, fault): one JSON document a file, of so many bytes at most, with or without a byte order mark."""
    files = (spark.read.option("pathGlobFilter", pattern) if pattern else spark.read).text(path, wholetext=True)
    text = F.regexp_replace("value", "^﻿", "")
    doc = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = files.select(F.input_file_name().alias("path"), F.octet_length("value").alias("bytes"), doc.alias("doc"))
    fault = F.when(F.col("bytes") > most, "too large").when(F.col("doc").isNull() | F.col("doc._corrupt").isNotNull(), "not JSON")
    return rows.select("path", F.when(fault.isNull(), F.col("doc").dropFields("_corrupt")).alias("doc"), fault.alias("fault"))


def _json(found: DataFrame, schema: str) -> DataFrame:
    """Lines with their JSON as `row` and what is wrong with it as `fault`."""
    row = F.from_json("text", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    found = found.withColumn("row", row)
    fault = F.when(F.trim(F.col("text")) == "", "blank line").when(F.col("row").isNull() | F.col("row._corrupt").isNotNull(), "not JSON")
    return found.select("path", "line", F.when(fault.isNull(), F.col("row").dropFields("_corrupt")).alias("row"), fault.alias("fault"), "last")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True, **where) -> DataFrame:
    """(path, line, row, fault): JSON lines; blank ones are a fault, or skipped where strict is false."""
    found = lines(spark, path, **where)
    if not strict:
        found = found.where(F.trim(F.col("text")) != "")
    return _json(found, schema).drop("last")


#: One cell of a CSV line with what leads to it: quoted with doubled quotes, or plain.
_CELL = r'(?:^|,)("(?:[^"]|"")*"|[^,"]*)'


def _cells(text: Column) -> Column:
    """The cells of a CSV line; null where quotes stand wrong."""
    sound = text.rlike(r'^(?:"(?:[^"]|"")*"|[^,"]*)(?:,(?:"(?:[^"]|"")*"|[^,"]*))*\z')
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.when(sound, F.transform(F.regexp_extract_all(text, F.lit(_CELL), 1), bare))


def csv_inventory(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of inventories with a header; lines without text are skipped.

    required names the id column first and the revision column last. Cells may be quoted, within a
    line. Ids are safe path names of up to 128 characters, unique in their file without regard to case; revisions are
    40 or 64 hexadecimal digits in either case, given in small letters; cells are trimmed.
    """
    text = lines(spark, path).where(F.regexp_replace("text", r'[\s,"]', "") != "")
    head = text.groupBy("path").agg(F.min(F.struct("line", "text")).alias("h")).select(F.col("path").alias("p"), F.col("h.line").alias("first"), _cells(F.col("h.text")).alias("names"))
    rows = text.join(head, F.col("path") == F.col("p")).where("line > first").withColumn("cells", _cells(F.col("text")))
    at = lambda c: F.trim(F.get(F.col("cells"), F.array_position("names", c) - 1))
    rows = rows.select("path", "line", "names", F.col("cells").isNull().alias("torn"), (F.size("cells") != F.size("names")).alias("ragged"), *[F.when(F.array_contains("names", c), at(c)).alias(c) for c in required])
    ident, revision = required[0], required[-1]
    rows = rows.withColumn(revision, F.lower(revision))
    twice = rows.groupBy(F.col("path").alias("p"), F.lower(ident).alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    missing = F.size(F.array_except(F.array(*[F.lit(c) for c in required]), "names")) > 0
    heads = head.select(F.col("p").alias("path"), F.col("first").alias("line"), F.when(F.col("names").isNull(), "quotes").when(F.size(F.array_distinct("names")) < F.size("names"), "repeated column").when(missing, "missing column").alias("fault"))
    blank = F.coalesce(F.col(ident), F.lit("")) == ""
    unsafe = ~F.col(ident).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z")
    hashed = F.coalesce(F.col(revision).rlike(r"^(?:[0-9a-f]{40}|[0-9a-f]{64})\z"), F.lit(False))
    bad = rows.select("path", "line", F.when(F.col("torn"), "quotes").when(F.col("ragged"), "width").when(blank, "no id").when(unsafe, "unsafe id").when(~hashed, "revision").alias("fault"))
    repeated = rows.join(twice, (F.lower(ident) == F.col("k")) & (F.col("path") == F.col("p"))).where("k <> ''").select("path", "line", F.lit("repeated id").alias("fault"))
    return rows.where("NOT torn AND NOT ragged").drop("names", "torn", "ragged"), heads.unionAll(bad).unionAll(repeated).where("fault IS NOT NULL")


def receipts(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last receipt of each id, without regard to case; a torn last line, without its line feed, does not count."""
    found = _json(lines(spark, path), schema).where("fault IS NULL AND NOT last")
    best = found.groupBy(F.lower(f"row.{key}").alias("receipt")).agg(F.max(F.struct("path", "line", "row")).alias("k"))
    return best.select("receipt", "k.line", "k.row.*")


def repository_files(spark: SparkSession, path: str, excluded: Column, suffixes: list[str]) -> DataFrame:
    """(path, bytes) of source files below path: of these suffixes, not excluded, and without a NUL byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.col("path").endswith(s)
    return files.where(wanted & ~excluded & (F.position(F.lit(b"\x00"), F.col("content")) == 0)).select("path", F.col("length").alias("bytes"))


#: One change of a NUL-separated list, right after the one before: a status and its path, or its old and its new path.
_CHANGE = r"\G\x00*(?:[RC][^\x00]*+\x00+[^\x00]++\x00+[^\x00]++|[^RC\x00][^\x00]*+\x00+[^\x00]++)"


def name_status(text: DataFrame) -> DataFrame:
    """(status, path) of NUL-separated change lists (a row with a column `z` each); renames and copies give their new path."""
    change = F.explode(F.regexp_extract_all("z", F.lit(_CHANGE), 0)).alias("c")
    parts = text.select(change).select(F.filter(F.split("c", "\0"), lambda x: x != "").alias("c"))
    return parts.select(F.substring(F.get("c", F.lit(0)), 1, 1).alias("status"), F.element_at("c", -1).alias("path"))


SARIF = """runs array<struct<tool struct<driver struct<rules array<struct<id string, name string, defaultConfiguration struct<level string>, properties struct<`security-severity` string, tags array<string>, cwe array<string>>>>>>, results array<struct<ruleId string, ruleIndex int, level string, kind string, baselineState string,
  message struct<text string>, properties struct<`security-severity` string>, suppressions array<struct<status string>>,
  locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int, endLine int>>>>>>>>"""


def sarif_results(docs: DataFrame) -> DataFrame:
    """A row a location of every result of SARIF documents (path, doc) that is not suppressed, absent, passed or not applicable.

    The rule is the one at ruleIndex, else the first with the result's id; a missing end is the start. The
    severity is that of the rule's score (else the result's), if it is a finite number above 0, else of
    the level, of which the rule may hold the default.
    """
    runs = docs.select("path", F.posexplode("doc.runs").alias("run", "r"))
    split = runs.select("path", "run", F.col("r.tool.driver.rules").alias("rules"), F.col("r.results").alias("results"))  # the run itself is not carried along with its results
    each = split.select("path", "run", "rules", F.posexplode("results").alias("result", "x"))
    held = F.coalesce(F.exists("x.suppressions", lambda s: F.coalesce(s["status"], F.lit("")) != "rejected"), F.lit(False))
    out = held | F.coalesce(F.col("x.baselineState") == "absent", F.lit(False)) | F.coalesce(F.col("x.kind").isin("pass", "notApplicable"), F.lit(False))
    rule = F.coalesce(F.get("rules", F.col("x.ruleIndex")), F.get(F.filter("rules", lambda r: r["id"] == F.col("x.ruleId")), F.lit(0)))
    each = each.where(~out).withColumn("rule", rule)
    number = F.coalesce("rule.properties.security-severity", "x.properties.security-severity").try_cast("double")
    score = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    told = F.coalesce("x.level", "rule.defaultConfiguration.level")
    severity = F.when(score > 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise(F.when(told == "error", "high").when(told == "warning", "medium").when(told == "note", "low").otherwise("unknown"))
    rows = each.select("path", "run", "result", F.coalesce("x.ruleId", "rule.id").alias("rule_id"), F.col("rule.name").alias("rule"), severity.alias("severity"), F.col("x.message.text").alias("message"), F.posexplode("x.locations").alias("place", "l"))
    at = F.col("l.physicalLocation.region")
    return rows.select("path", "run", "result", "rule_id", "rule", "severity", "message", "place", F.col("l.physicalLocation.artifactLocation.uri").alias("uri"), at["startLine"].alias("start_line"), F.coalesce(at["endLine"], at["startLine"]).alias("end_line"))
