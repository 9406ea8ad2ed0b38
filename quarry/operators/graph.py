"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.session import materialize


#: Edges, about, that are worth a task; a smaller table is not cut into more tasks and files than that.
EDGES_A_TASK = 100_000


def _fit(df: DataFrame, edges: int) -> DataFrame:
    """df in no more tasks than its share of edges is worth; tables that fill all partitions stay as they are."""
    tasks = -(-edges // EDGES_A_TASK)
    return df.coalesce(max(1, tasks)) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return _fit(_fit(moved, n).distinct(), n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    every = moved.unionAll(least.select("a", F.col("m").alias("b")))
    return _fit(_fit(every, n).distinct(), n)


def _settled(edges: DataFrame) -> DataFrame:
    """(node, component) of a table that is worth one task: its components by union-find there."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(batches)
        if not whole:
            return
        ends = pd.concat(whole)
        codes, nodes = pd.factorize(np.concatenate([ends["a"].to_numpy(), ends["b"].to_numpy()]), sort=True)  # codes are in the order of nodes
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(codes[: len(ends)].tolist(), codes[len(ends) :].tolist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        yield pd.DataFrame({"node": nodes, "component": nodes[[root(x) for x in range(len(nodes))]]})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(settle, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable, for every node with an edge.

    Edges are undirected; self links and null ends are ignored. Each round shuffles the edge
    table on one key with map-side minima and is written to the shared folder, in tasks and files
    as many as its edges are worth; the number of
    rounds grows with the logarithm of the longest chain. A table that is worth one task is settled
    in it, without rounds. Nothing but two totals per round reaches the driver.
    """
    now = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == seen or not total[0]:
            break
        if total[0] <= EDGES_A_TASK:
            return _settled(now)
        seen = tuple(total)
        now = materialize(_small_star(_large_star(_fit(now, total[0]), total[0]), total[0]))
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
