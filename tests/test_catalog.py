import pytest

from oracle import same
from quarry import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name])


#: Queries that SQL cannot express; plain versions test what they compute.
NO_SQL = {"max_matching", "line_hashes"}


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - NO_SQL == set(catalog.ORACLES)


def test_entry_imports_and_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_comparison_has_no_nested_loop(spark):
    plan = catalog.QUERIES["compare_status_by_target"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_components_of_chains_and_cycles(spark):
    from quarry.operators.graph import connected_components

    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from quarry.functions import text as T

    df = spark.createDataFrame([("=1+1", "Hello, World!", "a\nb"), ("ok", "--x--", ""), (" @x", "ü", "a\n")], "c string, s string, t string")
    got = df.select(T.guarded_cell(F.col("c")), T.slug(F.col("s")), T.line_count(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("'=1+1", "hello-world", 2), ("ok", "x", 1), ("' @x", "", 1)]


def test_tree_closure_rejects_cycles_and_follows_chains(spark):
    from quarry.operators.usage import closure

    chain = spark.createDataFrame([(0, None)] + [(i, i - 1) for i in range(1, 40)], "node long, parent long")
    assert {r["root"] for r in closure(chain).collect()} == {0}
