"""Session usage: cumulative counters, session trees, cost, streaks and the streaming twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.history import latest
from quarry.plans.session import materialize
from quarry.plans.views import table

#: Example rates in nanodollars a unit, by event type: plain, cached, written to the cache, and put out. They are a parameter of `cost`.
RATES = {"view": (310, 40, 420, 1700), "click": (2700, 260, 3900, 11000), "purchase": (17000, 1900, 23000, 88000), "error": (0, 0, 0, 0)}


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, ts, event_id, event_type, units): units are whole hundredths of the event's value."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS session", "ts", "event_id", "event_type", "CAST(round(value * 100) AS BIGINT) AS units")


SQL = "ev AS (SELECT user_id AS session, ts, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS units FROM events)"


def _by_session():
    return Window.partitionBy("session").orderBy("ts", "event_id")


def usage_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last counter of every session; counters replace each other, they are not added."""
    return latest(cents(spark, sf_dir), ["session"], ["ts", "event_id"], ["ts", "event_id", "units"]).select("session", "event_id", "units")


def usage_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters never fall: the running maximum, only where it changes."""
    rows = cents(spark, sf_dir).withColumn("high", F.max("units").over(_by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.withColumn("was", F.lag("high").over(_by_session())).where("was IS NULL OR was <> high").select("session", "event_id", "high")


def usage_budget_stop(spark: SparkSession, sf_dir: str, budget: int = 50_000) -> DataFrame:
    """The first event at which a session's summed units exceed the budget."""
    rows = cents(spark, sf_dir).withColumn("spent", F.sum("units").over(_by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where(F.col("spent") > budget).groupBy("session").agg(F.min(F.struct("ts", "event_id", "spent")).alias("k")).select("session", "k.event_id", "k.spent")


def cost(rows: DataFrame, rates: dict[str, tuple[int, int, int, int]]) -> DataFrame:
    """rows (kind, units, cached, written, put_out) with their cost; of an unknown kind it is null.

    Cached and written units are part of units and are priced at their own rates.
    """
    spark = rows.sparkSession
    prices = F.broadcast(spark.createDataFrame([(k, *r) for k, r in rates.items()], "kind string, r0 long, r1 long, r2 long, r3 long"))
    sums = (F.col("units") - F.col("cached") - F.col("written")) * F.col("r0") + F.col("cached") * F.col("r1") + F.col("written") * F.col("r2") + F.col("put_out") * F.col("r3")
    return rows.join(prices, "kind", "left").withColumn("cost", sums).drop("r0", "r1", "r2", "r3")


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanodollars by session; a session with an event of unknown rates has no cost."""
    rows = cents(spark, sf_dir).selectExpr("session", "event_type AS kind", "units", "units div 4 AS cached", "units div 10 AS written", "event_id % 50 AS put_out")
    known = F.when(F.count_if(F.col("cost").isNull()) == 0, F.sum("cost").cast("long"))
    return cost(rows, RATES).groupBy("session").agg(F.sum("units").alias("units"), known.alias("nanodollars"))


def closure(parents: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, root) of a forest (node, parent; null at roots), by doubling: rounds grow with the log of the depth."""
    now = materialize(parents.select("node", F.coalesce("parent", "node").alias("up")))
    for _ in range(max_depth):
        step = now.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        after = materialize(now.join(step, "up").select("node", F.col("upper").alias("up")))
        changed = after.join(now.withColumnRenamed("up", "was"), "node").where("up <> was").limit(1).count()
        now = after
        if not changed:
            return now.withColumnRenamed("up", "root")
    raise RuntimeError("the parents have a cycle")


def usage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all sessions below each root (a session's parent has half its number; 1 to 9 are roots)."""
    rows = cents(spark, sf_dir).groupBy("session").agg(F.sum("units").alias("units"))
    known = rows.select(F.col("session").alias("k"))
    parents = rows.select(F.col("session").alias("node"), F.when(F.col("session") >= 10, F.expr("session div 2")).alias("half"))
    parents = parents.join(known, F.col("half") == F.col("k"), "left").select("node", F.col("k").alias("parent"))
    return rows.join(closure(parents), F.col("session") == F.col("node")).groupBy("root").agg(F.count("*").alias("sessions"), F.sum("units").alias("units"))


def no_new_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs (tenths of the units) of a session since its last signup, at every event; a signup starts at none."""
    rows = cents(spark, sf_dir).withColumn("inputs", F.when(F.col("event_type") == "signup", 0).otherwise(F.expr("units div 10")))
    rows = rows.withColumn("island", F.count_if(F.col("event_type") == "signup").over(_by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy("session", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("session", "event_id", F.sum("inputs").over(inside).cast("long").alias("streak"))


def event_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events reduced to a status by session: failed with an error last, else complete with a purchase, else running."""
    rows = cents(spark, sf_dir)
    agg = rows.groupBy("session").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("k"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.count("*").alias("events"))
    return agg.select("session", "events", F.when(F.col("k.event_type") == "error", "failed").when(F.col("bought") > 0, "complete").otherwise("running").alias("status"))


QUERIES = {f.__name__: f for f in (usage_latest, usage_running, usage_budget_stop, usage_cost, usage_tree, no_new_streak, event_reduce)}
_LATEST = f"WITH {SQL} SELECT session, event_id, units FROM ev QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) = 1"
ORACLES = {
    "usage_latest": _LATEST,
    "usage_running": f"WITH {SQL}, r AS (SELECT *, max(units) OVER (PARTITION BY session ORDER BY ts, event_id) AS high FROM ev) SELECT session, event_id, high FROM r QUALIFY lag(high) OVER (PARTITION BY session ORDER BY ts, event_id) IS DISTINCT FROM high",
    "usage_budget_stop": f"WITH {SQL}, r AS (SELECT *, CAST(sum(units) OVER (PARTITION BY session ORDER BY ts, event_id) AS BIGINT) AS spent FROM ev) SELECT session, event_id, spent FROM r WHERE spent > 50000 QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts, event_id) = 1",
    "usage_cost": f"""WITH {SQL}, r AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {a}, {b}, {c}, {d})" for k, (a, b, c, d) in RATES.items())}) t(event_type, r0, r1, r2, r3)), c AS (
      SELECT session, units, (units - units // 4 - units // 10) * r0 + (units // 4) * r1 + (units // 10) * r2 + (event_id % 50) * r3 AS cost FROM ev LEFT JOIN r USING (event_type))
      SELECT session, CAST(sum(units) AS BIGINT) AS units, CASE WHEN count(*) = count(cost) THEN CAST(sum(cost) AS BIGINT) END AS nanodollars FROM c GROUP BY 1""",
    "usage_tree": f"""WITH RECURSIVE {SQL}, s AS (SELECT session, sum(units) AS units FROM ev GROUP BY 1), t AS (
      SELECT session, session AS root FROM s WHERE session < 10 OR session // 2 NOT IN (SELECT session FROM s)
      UNION ALL SELECT s.session, t.root FROM s JOIN t ON s.session >= 10 AND s.session // 2 = t.session)
      SELECT root, count(*) AS sessions, CAST(sum(units) AS BIGINT) AS units FROM t JOIN s USING (session) GROUP BY 1""",
    "no_new_streak": f"""WITH {SQL}, i AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY session ORDER BY ts, event_id) AS island FROM ev)
      SELECT session, event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 0 ELSE units // 10 END) OVER (PARTITION BY session, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM i""",
    "event_reduce": f"WITH {SQL} SELECT session, count(*) AS events, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'complete' ELSE 'running' END AS status FROM ev GROUP BY 1",
}
