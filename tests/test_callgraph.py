"""Call paths against a walk of every simple path."""

import random

import pytest

from quarry.operators import callgraph

RNG = random.Random(61)


def walks(calls, source, sinks, depth):
    """(path, ended) of every path tried from a source."""
    out, todo = [], [(source,)]
    while todo:
        path = todo.pop()
        for callee in calls.get(path[-1], ()):
            if callee not in path and len(path) <= depth:
                out.append(((*path, callee), callee in sinks))
                if callee not in sinks:
                    todo.append((*path, callee))
    return out


@pytest.mark.parametrize(("depth", "most"), [(32, 4096), (3, 4096), (32, 12), (1, 0)])
def test_paths_match_a_walk(spark, depth, most):
    edges = [(RNG.randrange(14), RNG.randrange(14)) for _ in range(26)]
    calls = {}
    for a, b in edges:
        calls.setdefault(a, set()).add(b)
    sources, sinks = list(range(0, 14, 2)), {3, 7, 8}
    told = set()
    for s in sources:
        tried = walks(calls, s, sinks, depth)
        if len(tried) > most:
            told |= {(s, c, (s, c), False) for c in calls.get(s, ()) if c in sinks and c != s}
        else:
            told |= {(s, p[-1], p, True) for p, ended in tried if ended}
    df = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "caller long, callee long")
    got = callgraph.call_paths(df, spark.createDataFrame([(s,) for s in [*sources, None]], "source long"), spark.createDataFrame([(s,) for s in sinks], "sink long"), depth, most).collect()
    assert {(r.source, r.sink, tuple(r.path), r.whole) for r in got} == told and len(got) == len(told)


def test_no_calls_no_paths(spark):
    none = spark.createDataFrame([], "caller long, callee long")
    assert callgraph.call_paths(none, spark.createDataFrame([(1,)], "source long"), spark.createDataFrame([(1,)], "sink long")).count() == 0
