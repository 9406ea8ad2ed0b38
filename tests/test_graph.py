"""Connected components against union-find, whatever tables are worth a task."""

import random

import pytest

from quarry.operators import graph

RNG = random.Random(1)


@pytest.mark.parametrize("worth", [100_000, 100])
def test_components_match_union_find(spark, monkeypatch, worth):
    monkeypatch.setattr(graph, "EDGES_A_TASK", worth)
    edges = [(RNG.randrange(400), RNG.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(900, 900 + i) for i in range(50)] + [(3, 3), (None, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in list(parent))
