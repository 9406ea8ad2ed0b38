"""Sets replaced as wholes: twice, with failures in between, and decisions added where they change."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.operators import snapshots
from quarry.plans.session import shared_dir

RNG = random.Random(23)


def test_a_replacement_is_whole_repeatable_and_survives_a_failure(spark):
    path = f"{shared_dir(spark)}/tests/{uuid.uuid4().hex}"
    read = lambda: sorted((r.scan, r.n, r.t) for r in snapshots.read_sets(spark, path, "scan", "long").collect())
    rows = lambda *l: spark.createDataFrame(list(l), "scan long, n long, t string")
    scans = lambda *l: spark.createDataFrame([(x,) for x in l], "scan long")
    first = [(1, 10, "a"), (1, 10, "a"), (2, 20, None), (3, 30, "c")]
    snapshots.replace_sets(path, scans(1, 2, 3, 3, None), rows(*first, (9, 9, "not named"), (None, 0, "no scan")), "scan", 4)
    assert read() == sorted(first, key=str)
    for _ in range(2):  # run twice: the same table
        snapshots.replace_sets(path, scans(2, 3), rows((2, 21, "new"), (2, 22, "new")), "scan", 4)
        assert read() == [(1, 10, "a"), (1, 10, "a"), (2, 21, "new"), (2, 22, "new")]
    broken = rows(*[(1, n, "x") for n in range(200)], *[(2, n, "x") for n in range(200)]).withColumn("t", F.when(F.col("n") == 150, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        snapshots.replace_sets(path, scans(1, 2), broken, "scan", 4)
    assert read() == [(1, 10, "a"), (1, 10, "a"), (2, 21, "new"), (2, 22, "new")]
    snapshots.replace_sets(path, scans(3), rows((3, 31, "back")), "scan", 4)
    assert read()[-1] == (3, 31, "back") and len(read()) == 5


def test_one_owner_is_written_by_many_tasks(spark):
    path = f"{shared_dir(spark)}/tests/{uuid.uuid4().hex}"
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("scan"), "id")
    snapshots.replace_sets(path, rows.select("scan"), rows, "scan", 16)
    got = snapshots.read_sets(spark, path, "scan", "long")
    assert got.count() == 4000 and len(got.inputFiles()) > 2


def test_decisions_that_change(spark):
    schema = "k long, status string, reason string, at long"
    rows = [(RNG.choice([1, 2, 3, None]), RNG.choice(["open", "closed"]), RNG.choice([None, "r"]), at) for at in range(60)]
    known, given = rows[:20], rows[20:]
    last, due = {}, []
    for k, s, r, at in known:
        last[k] = (s, r)
    for k, s, r, at in given:
        if last.get(k) != (s, r):
            due.append((k, s, r, at))
        last[k] = (s, r)
    got = snapshots.changed_decisions(spark.createDataFrame(known, schema), spark.createDataFrame(given, schema), ["k"], ["status", "reason"], ["at"])
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[3]) == due
    none = spark.createDataFrame([], schema)
    assert snapshots.changed_decisions(none, none, ["k"], ["status", "reason"], ["at"]).count() == 0
