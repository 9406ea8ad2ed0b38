"""Small tables of edges are settled without rounds."""

from quarry.operators import graph


def test_a_small_table_needs_no_round(spark, monkeypatch):
    monkeypatch.setattr(graph, "_large_star", None)
    edges = spark.createDataFrame([("b", "c"), ("c", "é"), ("x", "y"), ("a", "c")], "a string, b string")
    got = sorted(map(tuple, graph.connected_components(edges).collect()))
    assert got == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("é", "a")]
