import gzip
import time
from pathlib import Path

from pyspark.sql import functions as F

from quarry.operators import ingest
from quarry.sources import files


def test_lines_of_split_files(spark, tmp_path):
    kinds = ["", "a", "x\r", "é" * 30, '{"a":1}', "b" * 400]
    told = []
    for i, (n, end) in enumerate([(0, ""), (1, "\n"), (60, ""), (61, "\n"), (90, "t"), (30, "\n\n")]):
        text = "\n".join(kinds[(i + k * k) % 6] for k in range(n)) + end
        for name, opened, mark in (("a", open, b""), ("mark", open, b"\xef\xbb\xbf"), ("packed.gz", gzip.open, b"")):
            with opened(tmp_path / f"{i} {name}", "wb") as f:
                f.write(mark + text.encode())
            parts = text.split("\n")
            told += [(f"{i}%20{name}", k, x.removesuffix("\r"), k == len(parts)) for k, x in enumerate(parts, 1) if k < len(parts) or x]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        found = files.lines(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.path.rsplit("/", 1)[1], r.line, r.text, r["last"]) for r in found) == sorted(told)
    assert len({r.task for r in found if r.path.endswith("4%20a")}) > 1  # no task holds the file


def _ledgers(spark, monkeypatch):
    seen = []
    real = files.receipts
    monkeypatch.setattr(ingest.files, "receipts", lambda s, path, *a: seen.append(path) or real(s, path, *a))
    ingest.receipt_ledger(spark, "/root/testdata/sf0.001")
    return [p.read_text() for p in Path(seen[0].removeprefix("file:").removesuffix("/*")).glob("*/part-*")]


def test_ledgers_are_files_in_order_with_a_torn_line(spark, monkeypatch):
    texts = _ledgers(spark, monkeypatch)
    assert len(texts) == 8 and all(t.endswith('\n{"id":"task-1","status":"TORN"}') for t in texts)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").orderBy("o_orderkey").collect()
    told = [[f'{{"id":"{"Tt"[r.o_orderkey % 2]}ask-{r.o_custkey % 40}","status":"{r.o_orderstatus}"}}' for r in orders if r.o_custkey % 8 == k] for k in range(8)]
    assert sorted(t.split("\n")[1:-1] for t in texts) == sorted(told)


def test_long_change_lists(spark):
    n = 20_000
    changes = spark.createDataFrame([("".join(f"R100\0old{i}\0new{i}\0M\0m{i}\0" for i in range(n)),)], "z string")
    began = time.time()
    found = {tuple(r) for r in files.name_status(changes).collect()}
    assert found == {("R", f"new{i}") for i in range(n)} | {("M", f"m{i}") for i in range(n)}
    assert time.time() - began < 30  # a list grown by copies takes minutes


def test_change_lists_with_odd_places(spark):
    cases = [
        ("\0\0M\0\0a\0\0C75\0R\0M\0D\0C\0", [("M", "a"), ("C", "M"), ("D", "C")]), ("R100\0old", []), ("M\0a\0R100\0old\0", [("M", "a")]), ("M", []), ("", []), (None, []),
        ("R\0o\nld\0n\new", [("R", "n\new")]), ("é\0x", [("é", "x")]),
    ]
    for z, told in cases:
        assert [tuple(r) for r in files.name_status(spark.createDataFrame([(z,)], "z string")).collect()] == told


def test_results_do_not_carry_their_run(spark):
    docs = spark.createDataFrame([("p", "{}")], "path string, t string").select("path", F.from_json("t", files.SARIF).alias("doc"))
    plan = files.sarif_results(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(results#" in plan and "posexplode(r#" not in plan


def test_sarif_documents_do_not_grow_with_the_table(spark, monkeypatch):
    whole = sorted(map(tuple, ingest.sarif_seeds(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(ingest, "DOCUMENT_PARTS", 50)
    docs = ingest._sarif(spark, "/root/testdata/sf0.001").select(F.size(F.col("doc.runs")[0]["results"]).alias("n")).collect()
    assert len(docs) > 25 and max(r.n for r in docs) <= 50
    assert sorted(map(tuple, ingest.sarif_seeds(spark, "/root/testdata/sf0.001").collect())) == whole
