"""Queries by Structured Streaming over files: tails, cumulative counters, budgets, life cycles and worker states.

Each stream runs over what is there (availableNow), keeps its state in the shared folder, and writes
Parquet that is read back; nothing passes through the driver. The operators are in `sessions`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.session import shared_dir
from quarry.plans.views import table
from quarry.sources.tail import tailed
from quarry.streaming import sessions


def opened(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of a table: one file, or a folder of files; given as a pattern, as a plain path must be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def finished(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote; in `complete` and `update` mode the last state.

    A batch is written to a folder of its own number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        rows = each(batch, number) if each else batch
        rows.write.mode("overwrite").parquet(f"{place}/out/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out")


def _units(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").alias("session"), "ts", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("units"))


def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last counter of every session by a stream; counters replace each other."""
    found = _units(opened(spark, sf_dir, "events")).groupBy("session").agg(F.max(F.struct("ts", "event_id", "units")).alias("k"))
    return finished(found.select("session", "k.event_id", "k.units"), "complete").drop("batch")


def high_water_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest counter of every session by a stream: a snapshot that falls is ignored."""
    found = _units(opened(spark, sf_dir, "events")).groupBy("session").agg(F.max("units").alias("high"))
    return finished(found, "complete").drop("batch")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def budget_stream(spark: SparkSession, sf_dir: str, limit: int = 50_000) -> DataFrame:
    """Where the counters of a run's sessions first exceed a limit together; counters replace each other."""
    rows = _units(opened(spark, sf_dir, "events")).select((F.col("session") % 50).alias("run"), "session", F.col("event_id").alias("at"), F.col("units").alias("spent"))
    place = _place(spark, "budget")
    sessions.run_to_table(sessions.stateful(rows, "run", sessions.BudgetStop(limit)), place)
    return sessions.changes_of(spark, place).select("run", "session", "spent")


def tail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines appended to log files between two runs of a tail, counted by role; each line is read once."""
    place, rows = _place(spark, "tail"), table(spark, sf_dir, "conversations")
    lines = rows.select((F.col("turn") % 2).alias("half"), F.to_json(F.struct("conv_id", "turn", "role")).alias("value"))
    for half in (0, 1):
        lines.where(F.col("half") == half).select("value").repartition(3).write.mode("append").option("lineSep", "\n").text(f"{place}/logs")
        sessions.run_to_table(tailed(spark, f"{place}/logs", suffix=".txt", range_bytes=50_000), place)
    found = sessions.changes_of(spark, place).select(F.try_variant_get(F.try_parse_json("value"), "$.role", "string").alias("role"))
    return found.groupBy("role").agg(F.count("*").alias("n"))


def lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads reduced to a status by a stateful stream: turns are counted, first turn, last turn and its role are kept."""
    rows = opened(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    last = F.max(F.when(F.col("role").isNotNull() & F.col("turn").isNotNull(), F.struct("turn", "role")))["role"]
    found = rows.groupBy("conv_id").agg(F.count("*").alias("events"), F.min("turn").alias("first"), last.alias("role"))
    status = F.when(F.col("first") != 0, "orphan").when(F.col("role") == "assistant", "complete").otherwise("failed")
    every = finished(found.select("conv_id", "events", status.alias("status")), "update")
    return every.groupBy("conv_id").agg(F.max(F.struct("batch", "events", "status")).alias("k")).select("conv_id", "k.events", "k.status")


def event_reduce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last valid report of each session's workers, from messages with marker lines."""
    phase = F.element_at(F.array(*[F.lit(p) for p in (*sessions.PHASES, "cleanup")]), (F.col("event_id") % 5 + 1).cast("int"))
    report = F.to_json(F.struct(phase.alias("phase"), (F.col("event_id") % 1500).alias("planned"), (F.col("event_id") % 700).alias("started")))
    line = F.concat(F.lit("WORKER_STATUS "), report)
    text = F.when(F.col("event_id") % 11 == 0, F.concat(line, F.lit("\n"), line)).otherwise(F.concat(F.lit("at work\r\n"), line))
    messages = opened(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), text.alias("text"))
    place = _place(spark, "workers")
    sessions.run_to_table(sessions.stateful(sessions.worker_reports(messages), "session", sessions.WorkerStates()), place)
    return sessions.current(sessions.changes_of(spark, place), "session")


QUERIES = {f.__name__: f for f in (usage_stream, high_water_stream, budget_stream, tail_stream, lifecycle_stream, event_reduce_stream)}
_EV = "WITH ev AS (SELECT user_id AS session, ts, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS units FROM events)"
ORACLES = {
    "usage_stream": f"{_EV} SELECT session, event_id, units FROM ev QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) = 1",
    "high_water_stream": f"{_EV} SELECT session, max(units) AS high FROM ev GROUP BY 1",
    "budget_stream": f"""{_EV}, s AS (SELECT session % 50 AS run, session, event_id AS at_, units, greatest(0, units - coalesce(max(units) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS more FROM ev),
      t AS (SELECT *, sum(more) OVER (PARTITION BY run ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS total FROM s) SELECT run, session, CAST(total AS BIGINT) AS spent FROM t WHERE total > 50000 QUALIFY row_number() OVER (PARTITION BY run ORDER BY at_) = 1""",
    "tail_stream": "SELECT role, count(*) AS n FROM conversations GROUP BY 1",
    "lifecycle_stream": "SELECT conv_id, count(*) AS events, CASE WHEN min(turn) <> 0 THEN 'orphan' WHEN arg_max(role, turn) = 'assistant' THEN 'complete' ELSE 'failed' END AS status FROM conversations GROUP BY 1",
    "event_reduce_stream": """WITH r AS (SELECT user_id AS session, event_id, ['ranking', 'file_review', 'validation', 'attack_path', 'cleanup'][event_id % 5 + 1] AS phase, event_id % 1500 AS planned, event_id % 700 AS started FROM events WHERE event_id % 11 <> 0)
      SELECT session, phase, CAST(planned AS BIGINT) AS planned, CAST(started AS BIGINT) AS started FROM r WHERE phase <> 'cleanup' AND planned <= 1024 AND started <= planned QUALIFY row_number() OVER (PARTITION BY session ORDER BY event_id DESC) = 1""",
}
