"""Queries that set occurrences against each other read lines and orders once, and calls are not sent through the driver."""

import pytest

from quarry.operators import callgraph, evidence, history
from quarry.plans import views
from tests.oracle import SF


@pytest.mark.parametrize("query", [history.linked_occurrences, history.linked_both_directions, evidence.aligned_roles])
def test_lines_are_joined_once(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == plan.count("Relation [o_orderkey") == 1


def test_runs_of_years_are_the_components_of_matches(spark, monkeypatch):
    rows = [(1, 7, y, i) for y, i in ((2000, 1), (2001, 2), (2002, 4), (2003, 5), (2005, 5), (2006, None), (2007, 5), (2008, 5))] + [(1, None, 2000, 1), (1, None, 2001, 1), (2, 7, 2004, 5)]
    occ = spark.createDataFrame(rows, "target_id long, finding_id long, yr long, line long").selectExpr("*", "(target_id * 10000 + yr) * 100 + finding_id AS occurrence_id")
    monkeypatch.setattr(views, "occurrences", lambda *_: occ)
    node = lambda y: (10000 + y) * 100 + 7
    got = sorted(tuple(r) for r in history.linked_occurrences(spark, "").collect())
    assert got == [(node(y), node(a), node(a), node(b), 2) for a, b in ((2000, 2001), (2002, 2003), (2007, 2008)) for y in (a, b)]
    both = sorted(tuple(r) for r in history.linked_both_directions(spark, "").collect())
    assert both == sorted(p for a in (2000, 2002, 2007) for p in ((node(a), node(a + 1)), (node(a + 1), node(a))))


def test_no_round_of_calls_is_broadcast(spark, monkeypatch):
    plans, plain = [], callgraph.materialize
    monkeypatch.setattr(callgraph, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    found = callgraph.sink_paths(spark, SF.replace("0.001", "0.01"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() and not any("Broadcast" in p for p in plans)
