"""Call paths from sources to sinks, grown call by call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.session import materialize
from quarry.plans.views import table

#: Fixed: calls of a path, and paths that are tried for a source, at most.
MOST_CALLS, MOST_PATHS = 32, 4096


def call_paths(calls: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int = MOST_CALLS, most: int = MOST_PATHS) -> DataFrame:
    """(source, sink, path, whole): the paths of calls (caller, callee) from sources (source) to the first sink (sink) on them.

    A path visits nothing twice and has at most depth calls; source is its first and sink its last
    place. A source for which more than `most` paths, finished or not, are tried falls back to the
    sinks that it calls itself, with whole false; other sources are not touched by it. Only paths
    that grew in the last round are joined again, so a source costs at most `most` rows a round and
    their calls. Null ends and repeated rows say nothing; a source that is a sink has no path of no calls.
    Joins are merges by hint: the sizes of grown tables are guessed far too small, and a broadcast
    sends the table of calls through the driver in every round.
    """
    asked = sources.select("source").where("source IS NOT NULL").distinct()
    ends = sinks.select(F.col("sink").alias("callee"), F.lit(True).alias("_sink")).where("callee IS NOT NULL").distinct()
    whole = calls.select("caller", "callee").where("caller IS NOT NULL AND callee IS NOT NULL").distinct()
    calls = materialize(whole.join(ends.hint("merge"), "callee", "left").select("caller", "callee", F.coalesce("_sink", F.lit(False)).alias("ended"))).hint("merge")
    open_paths = asked.select("source", F.array("source").alias("path"))
    done, tried, crowded = [], None, None
    for _ in range(depth):
        step = open_paths.join(calls, F.element_at("path", -1) == F.col("caller")).where(~F.array_contains("path", F.col("callee")))
        grown = materialize(step.select("source", F.array_append("path", F.col("callee")).alias("path"), "ended"))
        counts = grown.groupBy("source").agg(F.count("*").alias("n"))
        tried = materialize(counts if tried is None else tried.unionAll(counts).groupBy("source").agg(F.sum("n").alias("n")))
        crowded = tried.where(F.col("n") > most).select("source").hint("merge")
        done.append(grown.where("ended"))
        open_paths = grown.where("NOT ended").join(crowded, "source", "left_anti").select("source", "path")
        if not open_paths.take(1):
            break
    found = reduce(DataFrame.unionAll, done).join(crowded, "source", "left_anti").select("source", "path", F.lit(True).alias("whole"))
    direct = crowded.join(calls, F.col("source") == F.col("caller")).where("source <> callee AND ended").select("source", F.array("source", "callee").alias("path"), F.lit(False).alias("whole"))
    return found.unionAll(direct).select("source", F.element_at("path", -1).alias("sink"), "path", "whole")


def sink_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call paths from every 97th part to the next 30th, with sources of more than 60 tries cut to their own calls."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    calls = part.select(k.alias("caller"), F.explode(F.array(F.expr("p_partkey div 2"), k + 1, F.when(k % 4 == 0, k + 2))).alias("callee"))
    found = call_paths(calls, part.where("p_partkey % 97 = 0").toDF("source"), part.where("p_partkey % 30 = 0").toDF("sink"), depth=6, most=60)
    return found.select("source", "sink", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "whole")


QUERIES = {"sink_paths": sink_paths}
ORACLES = {
    "sink_paths": """WITH RECURSIVE c AS (SELECT DISTINCT a, b FROM (SELECT p_partkey AS a, unnest([p_partkey // 2, p_partkey + 1, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 2 END]) AS b FROM part) WHERE b IS NOT NULL
      ), s AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 30 = 0
      ), r(source, node, path, calls, ended) AS (
        SELECT p_partkey, p_partkey, [p_partkey], 0, false FROM part WHERE p_partkey % 97 = 0
        UNION ALL SELECT source, c.b, list_append(path, c.b), calls + 1, c.b IN (SELECT k FROM s) FROM r JOIN c ON c.a = r.node WHERE NOT ended AND calls < 6 AND NOT list_contains(path, c.b)
      ), big AS (SELECT source FROM r WHERE calls > 0 GROUP BY 1 HAVING count(*) > 60)
      SELECT source, node AS sink, array_to_string(path, '>') AS path, true AS whole FROM r WHERE ended AND source NOT IN (SELECT source FROM big)
      UNION ALL SELECT source, b, source || '>' || b, false FROM big JOIN c ON a = source JOIN s ON b = k WHERE a <> b""",
}
