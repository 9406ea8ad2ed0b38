"""State kept as rows: upserts, replacements, shredding, transitions, resumption, life cycles.

Snapshots replace each other as whole tables; what a database would refuse is found as violations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans import views
from quarry.plans.views import table

#: Event types that may follow each other, for the two machines below.
REMEDIATION = {"view": ["view", "click", "signup"], "click": ["view", "click", "purchase", "error"], "signup": ["view", "click"], "purchase": ["view", "signup", "error"], "error": ["view", "error"]}
WORKER = {"signup": ["view", "click", "error"], "view": ["view", "click", "purchase"], "click": ["click", "purchase", "error"], "purchase": ["signup"], "error": ["signup", "view"]}
PHASES = ["signup", "view", "click", "purchase", "error"]
NOW = "TIMESTAMP_NTZ '2024-01-30 12:00:00'"


def triage_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage of a finding over its scans, one row where the status or its reason changes."""
    occ = views.occurrences(spark, sf_dir).select("target_id", "finding_id", "yr", F.coalesce("triage", F.lit("open")).alias("status"), F.coalesce("reason", F.lit("")).alias("reason"))
    w = Window.partitionBy("target_id", "finding_id").orderBy("yr")
    rows = occ.withColumn("s", F.lag("status").over(w)).withColumn("r", F.lag("reason").over(w))
    return rows.where("s IS NULL OR s <> status OR r <> reason").drop("s", "r")


def target_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets after an insert that leaves known ones as they are."""
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("target_id"), F.col("s_name").alias("name"))
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target_id")).distinct().withColumn("name", F.concat(F.lit("target "), "target_id"))
    return known.unionAll(asked.join(known, "target_id", "left_anti"))


def scan_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after every third scan was written anew with its criticals alone: its old rows go as a whole."""
    occ = views.occurrences(spark, sf_dir).select("scan_id", "finding_id", "sev")
    new = occ.where("scan_id % 3 = 0 AND sev <= 1").withColumn("source", F.lit("new"))
    scans = occ.where("scan_id % 3 = 0").select("scan_id").distinct()
    return occ.join(scans, "scan_id", "left_anti").withColumn("source", F.lit("old")).unionAll(new)


def shred_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested findings of an order shredded into locations, with their place and an end that defaults to the start."""
    one = F.struct(F.col("l_partkey").alias("path"), (F.col("l_linenumber") * 10).alias("start"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") * 10 + 5).alias("end"))
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.array_sort(F.collect_list(one)).alias("locations"))
    nested = nested.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "locations")).alias("findings"))
    each = nested.select("l_orderkey", F.explode("findings").alias("f")).select("l_orderkey", "f.l_suppkey", F.posexplode("f.locations").alias("place", "l"))
    return each.select("l_orderkey", "l_suppkey", F.col("place").cast("long").alias("place"), F.col("l.path").alias("path"), F.col("l.start").cast("long").alias("start_line"), F.coalesce("l.end", "l.start").cast("long").alias("end_line"))


def violations(rows: DataFrame, key: str, order: list[str], state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """(key, order, was, now) where a state follows one that it may not follow."""
    spark = rows.sparkSession
    legal = spark.createDataFrame([(a, b) for a, to in allowed.items() for b in to], "was string, now string")
    steps = rows.select(key, *order, F.col(state).alias("now"), F.lag(state).over(Window.partitionBy(key).orderBy(*order)).alias("was"))
    return steps.where("was IS NOT NULL").join(F.broadcast(legal), ["was", "now"], "left_anti").select(key, *order, "was", "now")


def remediation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", REMEDIATION).drop("ts")


def worker_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", WORKER).drop("ts")


def phase_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose phase falls below the one before, or whose counter falls within a phase."""
    phase = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", phase.alias("phase"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumn("p", F.lag("phase").over(w)).withColumn("c", F.lag("k").over(w))
    kind = F.when(F.col("phase") < F.col("p"), "phase").when((F.col("phase") == F.col("p")) & (F.col("k") < F.col("c")), "counter")
    return rows.select("user_id", "event_id", kind.alias("kind")).where("kind IS NOT NULL")


def reduce_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that may be reduced: two inputs at least, or one where the hard cap allows a single one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("inputs"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.where((F.col("inputs") >= 2) | ((F.col("inputs") == 1) & (F.col("o_orderpriority") == "1-URGENT"))).select("o_orderkey", "inputs")


def terminal_states(spark: SparkSession, sf_dir: str, streak: int = 3, most: int = 60) -> DataFrame:
    """How sessions may end: saturated after enough events without a signup, capped after enough events, else not yet."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    last = rows.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("at"))).alias("signup"), F.count("*").alias("events"))
    both = rows.join(last, "user_id").groupBy("user_id", "events").agg(F.count_if(F.col("signup").isNull() | (F.col("at") > F.col("signup"))).alias("streak"))
    return both.select("user_id", "events", "streak", F.when(F.col("streak") >= streak, "saturated").when(F.col("events") >= most, "capped").otherwise("running").alias("state"))


def prefix_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reducer inputs that are not the ordered prefix of a session's results; every seventh session skips its second one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    results = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))
    shifted = F.when((F.col("user_id") % 7 == 0) & (F.col("place") >= 2), F.col("place") + 1).otherwise(F.col("place"))
    inputs = results.where("place <= 3").select("user_id", shifted.alias("place"), F.col("place").alias("input"))
    chosen = inputs.join(results, ["user_id", "place"]).select("user_id", "input", "event_id")
    due = results.select("user_id", F.col("place").alias("input"), F.col("event_id").alias("due"))
    return chosen.join(due, ["user_id", "input"]).where("event_id <> due")


def ledger_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each task by its last receipt: done with its artifacts there is skipped, else the next attempt."""
    receipts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("k"), F.count("*").alias("attempts"))
    artifacts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a")).distinct()
    rows = receipts.join(artifacts, F.col("k.o_orderkey") == F.col("a"), "left")
    done = (F.col("k.o_orderstatus") == "F") & F.col("a").isNotNull()
    return rows.select("task", F.col("k.o_orderkey").alias("receipt"), F.when(done, "skip").otherwise("run").alias("action"), F.when(~done, F.col("attempts") + 1).alias("attempt"))


def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(status == "F").alias("completed"), F.count_if(status == "P").alias("failed"), F.count_if(~status.isin("F", "P")).alias("open"))


def scan_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads reduced to a status: started at turn 0, a retry for every user turn after a user turn, done if an assistant spoke last."""
    rows = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("again", (F.col("role") == "user") & (F.lag("role").over(w) == "user"))
    agg = rows.groupBy("conv_id").agg(F.min("turn").alias("first"), F.count("*").alias("events"), F.count_if("again").alias("retries"), F.max(F.struct("turn", "role")).alias("k"))
    return agg.select("conv_id", "events", "retries", F.when(F.col("first") != 0, "orphan").when(F.col("k.role") == "assistant", "complete").otherwise("failed").alias("status"))


def expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that ran out by a fixed time: 120 seconds after the last event, 900 after a purchase."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("k"))
    seconds = F.when(F.col("k.event_type") == "purchase", 900).otherwise(120)
    return last.select("user_id", (F.expr("k.ts + make_dt_interval(0, 0, 0, CASE WHEN k.event_type = 'purchase' THEN 900 ELSE 120 END)") < F.expr(NOW)).alias("expired"), seconds.cast("long").alias("lease"))


def same_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which neighbours are one repository: by folder, or by the origin of their remotes; a union of equi-joins."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") % 5).alias("folder"), F.concat(F.lit("host/"), (F.col("s_nationkey") % 3).cast("string")).alias("origin"))
    right = ids.select((F.col("a") - 1).alias("b"), "folder", "origin")
    by = [ids.join(right, (F.col("a") == F.col("b")) & (ids[c] == right[c])).select("a", (F.col("b") + 1).alias("other")) for c in ("folder", "origin")]
    return by[0].union(by[1]).distinct()


QUERIES = {f.__name__: f for f in (triage_decisions, target_inserts, scan_replacement, shred_locations, remediation_violations, worker_violations, phase_violations, reduce_ready, terminal_states, prefix_violations, ledger_resume, task_counts, scan_lifecycle, expired_leases, same_repository)}


def _illegal(allowed: dict[str, list[str]]) -> str:
    legal = " OR ".join(f"(was = '{a}' AND now IN ({', '.join(repr(b) for b in to)}))" for a, to in allowed.items())
    return f"SELECT user_id, event_id, was, now FROM (SELECT user_id, event_id, event_type AS now, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NOT NULL AND NOT ({legal})"


ORACLES = {
    "triage_decisions": f"WITH {views.SQL}, d AS (SELECT target_id, finding_id, yr, coalesce(triage, 'open') AS status, coalesce(reason, '') AS reason FROM occ) SELECT * FROM d QUALIFY (status, reason) IS DISTINCT FROM lag((status, reason)) OVER (PARTITION BY target_id, finding_id ORDER BY yr)",
    "target_inserts": "SELECT s_suppkey AS target_id, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT DISTINCT l_suppkey, 'target ' || l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)",
    "scan_replacement": f"WITH {views.SQL} SELECT scan_id, finding_id, sev, CASE WHEN scan_id % 3 = 0 THEN 'new' ELSE 'old' END AS source FROM occ WHERE scan_id % 3 <> 0 OR sev <= 1",
    "shred_locations": "WITH l AS (SELECT l_orderkey, l_suppkey, l_partkey AS path, l_linenumber * 10 AS s, CASE WHEN l_returnflag <> 'N' THEN l_linenumber * 10 + 5 END AS e FROM lineitem) SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY path, s, e NULLS FIRST) - 1 AS place, path, s AS start_line, coalesce(e, s) AS end_line FROM l",
    "remediation_violations": _illegal(REMEDIATION),
    "worker_violations": _illegal(WORKER),
    "phase_violations": f"WITH e AS (SELECT user_id, ts, event_id, list_position({PHASES}, event_type) AS p, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), l AS (SELECT *, lag(p) OVER w AS lp, lag(k) OVER w AS lk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, CASE WHEN p < lp THEN 'phase' ELSE 'counter' END AS kind FROM l WHERE p < lp OR (p = lp AND k < lk)",
    "reduce_ready": "SELECT o_orderkey, n AS inputs FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n >= 2 OR o_orderpriority = '1-URGENT'",
    "terminal_states": "WITH s AS (SELECT user_id, count(*) AS events, count(*) FILTER (r > coalesce(last, 0)) AS streak FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN r END) OVER (PARTITION BY user_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)) GROUP BY 1) SELECT *, CASE WHEN streak >= 3 THEN 'saturated' WHEN events >= 60 THEN 'capped' ELSE 'running' END AS state FROM s",
    "prefix_violations": "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events) SELECT a.user_id, a.place AS input, b.event_id, a.event_id AS due FROM r a JOIN r b ON a.user_id = b.user_id AND b.place = a.place + 1 WHERE a.user_id % 7 = 0 AND a.place IN (2, 3)",
    "ledger_resume": "WITH r AS (SELECT o_custkey AS task, o_orderkey AS receipt, o_orderstatus AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), d AS (SELECT *, s = 'F' AND receipt IN (SELECT l_orderkey FROM lineitem) AS done FROM r) SELECT task, receipt, CASE WHEN done THEN 'skip' ELSE 'run' END AS action, CASE WHEN NOT done THEN n + 1 END AS attempt FROM d",
    "task_counts": "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS open FROM orders GROUP BY 1",
    "scan_lifecycle": "WITH c AS (SELECT *, role = 'user' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' AS again FROM conversations) SELECT conv_id, count(*) AS events, count(*) FILTER (again) AS retries, CASE WHEN min(turn) <> 0 THEN 'orphan' WHEN arg_max(role, turn) = 'assistant' THEN 'complete' ELSE 'failed' END AS status FROM c GROUP BY 1",
    "expired_leases": "WITH l AS (SELECT user_id, ts, CASE WHEN event_type = 'purchase' THEN 900 ELSE 120 END AS lease FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, ts + to_seconds(lease) < TIMESTAMP '2024-01-30 12:00:00' AS expired, lease FROM l",
    "same_repository": "SELECT a.s_suppkey AS a, b.s_suppkey AS other FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_nationkey % 5 = b.s_nationkey % 5 OR a.s_nationkey % 3 = b.s_nationkey % 3",
}
