"""Sessions followed line by line: usage counters, spending limits and worker states as stateful streams.

State lives in the state store (RocksDB, as `transformWithState` needs it), one key a session or
run, and is given up when a key has been idle; every stream emits changes only (update mode).
Counters are cumulative: a new one replaces the last, and one that falls is ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A key's state is dropped after so long without rows.
IDLE_MS = 24 * 3600 * 1000
#: Fixed: the largest whole number of a counter, workers at most, bytes of a status text at most, phases.
MOST_COUNT, MOST_WORKERS, STATUS_BYTES = 2**53 - 1, 1024, 65_536
PHASES = ("ranking", "file_review", "validation", "attack_path")


def whole(value: Column, most: int = MOST_COUNT) -> Column:
    """A VARIANT that is a whole number from 0 to most, as long; null for anything else, numbers in quotes too."""
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
    return F.when((number == F.floor(number)) & number.between(0, most), number.cast("long"))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def session_records(lines: DataFrame) -> DataFrame:
    """(path, at, kind, thread, parent, input, cached, written, output, reasoning) of session lines (path, at, value).

    kind is `meta` (thread and parent ids) or `usage` (cumulative counters). Lines that are no JSON
    object of these kinds are left out, and so are counters that are no whole numbers or do not add
    up: cached and written are part of input, reasoning is part of output.
    """
    part = lambda path, kind="variant": F.try_variant_get("r", path, kind)
    said = lambda path: F.when(F.schema_of_variant(part(path)) == "STRING", part(path, "string"))
    absent = lambda v: v.isNull() | (F.schema_of_variant(v) == "VOID")
    count = lambda path: whole(part(path))
    optional = lambda *paths: F.coalesce(*[F.when(~absent(part(p)), F.coalesce(count(p), F.lit(-1))) for p in paths], F.lit(0))
    usage = "$.payload.info.total_token_usage"
    rows = lines.select("path", "at", F.try_parse_json("value").alias("r"))
    rows = rows.where(_is_object(F.col("r")) & _is_object(part("$.payload")))
    found = rows.select(
        "path", "at", said("$.type").alias("type"), said("$.payload.type").alias("subtype"),
        said("$.payload.id").alias("thread"), F.coalesce(said("$.payload.parent_thread_id"), F.when(absent(part("$.payload.parent_thread_id")), said("$.payload.source.subagent.thread_spawn.parent_thread_id"))).alias("parent"),
        count(f"{usage}.input_tokens").alias("input"), optional(f"{usage}.cached_input_tokens").alias("cached"),
        optional(f"{usage}.cache_write_input_tokens", f"{usage}.cache_write_tokens").alias("written"),
        count(f"{usage}.output_tokens").alias("output"), optional(f"{usage}.reasoning_output_tokens").alias("reasoning"),
    )
    sound = (F.least("cached", "written", "reasoning") >= 0) & (F.col("cached") + F.col("written") <= F.col("input")) & (F.col("reasoning") <= F.col("output"))
    kind = F.when(F.col("type") == "session_meta", "meta").when((F.col("type") == "event_msg") & (F.col("subtype") == "token_count") & sound, "usage")
    counters = [F.when(F.col("kind") == "usage", F.col(c)).alias(c) for c in ("input", "cached", "written", "output", "reasoning")]
    ids = [F.when(F.col("kind") == "meta", F.col(c)).alias(c) for c in ("thread", "parent")]
    return found.withColumn("kind", kind).where("kind IS NOT NULL").select("path", "at", "kind", *ids, *counters)


class _Idle(StatefulProcessor):
    """A processor whose keys are dropped when they have been idle."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = self.opened(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self.step(key, rows)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in self.states:
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class LatestUsage(_Idle):
    """The ids and the last counters of a session's file, each time they change."""

    OUT = "path string, thread string, parent string, input long, cached long, written long, output long, reasoning long"

    def opened(self, handle):
        self.held = handle.getValueState("held", "at_thread long, thread string, at_parent long, parent string, at_usage long, input long, cached long, written long, output long, reasoning long")
        return [self.held]

    def step(self, key, rows):
        before = self.held.get() if self.held.exists() else (-1, None, -1, None, -1, None, None, None, None, None)
        now = list(before)
        for r in rows:
            if r.thread is not None and r.at > now[0]:
                now[0:2] = r.at, r.thread
            if r.parent is not None and r.at > now[2]:
                now[2:4] = r.at, r.parent
            if r.kind == "usage" and r.at > now[4]:
                now[4:] = r.at, r.input, r.cached, r.written, r.output, r.reasoning
        self.held.update(tuple(now))
        if (now[1], now[3], *now[5:]) != (before[1], before[3], *before[5:]):
            yield Row(path=key[0], thread=now[1], parent=now[3], input=now[5], cached=now[6], written=now[7], output=now[8], reasoning=now[9])


class BudgetStop(_Idle):
    """One row a run, when the counters of its sessions together first exceed the limit.

    The rows of a run in one batch are put in order in memory; the stream's trigger bounds them. A
    counter is read and written once a batch; a run that was stopped needs none.
    """

    OUT = "run long, session long, spent long"

    def __init__(self, limit: int, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.limit = limit

    def opened(self, handle):
        self.counters = handle.getMapState("counters", "session long", "spent long")
        self.total = handle.getValueState("total", "spent long, stopped boolean")
        return [self.counters, self.total]

    def step(self, key, rows):
        spent, stopped = self.total.get() if self.total.exists() else (0, False)
        if stopped:  # nothing more is said of the run
            deque(rows, maxlen=0)
            return
        known, risen = {}, {}
        for r in sorted(rows, key=lambda r: r.at):
            if r.session not in known:
                known[r.session] = self.counters.getValue((r.session,))[0] if self.counters.containsKey((r.session,)) else 0
            if r.spent <= known[r.session]:
                continue
            spent += r.spent - known[r.session]
            known[r.session] = risen[r.session] = r.spent
            if spent > self.limit:
                stopped = True
                self.counters.clear()
                yield Row(run=key[0], session=r.session, spent=spent)
                break
        if not stopped:
            for session, now in risen.items():
                self.counters.updateValue((session,), (now,))
        self.total.update((spent, stopped))


def _status_of(lines: Column, prefix: str) -> Column:
    """The only marker line of a text, as VARIANT; null for none or several."""
    marked = F.filter(lines, lambda x: x.startswith(prefix))
    return F.when(F.size(marked) == 1, F.try_parse_json(F.substring(marked[0], F.lit(len(prefix) + 1), F.length(marked[0]))))


def worker_reports(events: DataFrame, prefix: str = "WORKER_STATUS ") -> DataFrame:
    """(session, at, phase, planned, started) of the messages (session, at, text) that report workers.

    A message reports if it has at most 64 KiB and exactly one line that begins with the prefix,
    whose rest is an object of a known phase and two counts up to 1024, started at most planned.
    """
    said = lambda k: F.try_variant_get("r", f"$.{k}", "string")
    count = lambda k: whole(F.try_variant_get("r", f"$.{k}", "variant"), MOST_WORKERS).alias(k)
    keys = F.size(F.map_keys(F.try_variant_get("r", "$", "map<string,variant>")))
    rows = events.where(F.octet_length("text") <= STATUS_BYTES).select("session", "at", _status_of(F.split("text", r"\r?\n"), prefix).alias("r"))
    rows = rows.where(_is_object(F.col("r")) & (keys == 3)).select("session", "at", said("phase").alias("phase"), count("planned"), count("started"))
    return rows.where(F.col("phase").isin(*PHASES) & (F.col("started") <= F.col("planned")))


class WorkerStates(_Idle):
    """The last report of a session's workers, each time it changes."""

    OUT = "session long, phase string, planned long, started long"

    def opened(self, handle):
        self.held = handle.getValueState("held", "at long, phase string, planned long, started long")
        return [self.held]

    def step(self, key, rows):
        before = self.held.get() if self.held.exists() else (-1, None, None, None)
        now = max([tuple(before), *((r.at, r.phase, r.planned, r.started) for r in rows)], key=lambda t: t[0])
        if now[0] > before[0]:
            self.held.update(now)
            if now[1:] != tuple(before[1:]):
                yield Row(session=key[0], phase=now[1], planned=now[2], started=now[3])


def stateful(rows: DataFrame, key: str, processor: _Idle) -> DataFrame:
    """The stream of a processor's rows, by key."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # timers would ask for batches without rows for ever; they are seen to in the next batch that has some
    rows.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return rows.groupBy(key).transformWithState(processor, processor.OUT, "update", "processingTime")


def run_to_table(changes: DataFrame, place: str) -> None:
    """Runs a stream over what is there, from where the checkpoint under place ends; each batch is written once.

    A batch goes to a folder of its number, so one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def changes_of(spark: SparkSession, place: str) -> DataFrame:
    """All changes that runs under place have written, with their batch."""
    return spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out")


def current(changes: DataFrame, key: str) -> DataFrame:
    """The last change of every key."""
    rest = [c for c in changes.columns if c not in (key, "batch")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("k")).select(key, "k.*")


def run_usage(sessions: DataFrame) -> DataFrame:
    """(run, input, cached, written, output, reasoning) of sessions (thread, parent, counters): sums over each tree of threads.

    A run is a thread without a parent among the sessions; threads whose parents form a cycle belong to none.
    """
    from quarry.operators.usage import closure

    known = sessions.where("thread IS NOT NULL").groupBy("thread").agg(F.max("parent").alias("parent"))
    ids = known.select(F.col("thread").alias("parent"), F.lit(True).alias("there"))
    tree = closure(known.join(ids, "parent", "left").select(F.col("thread").alias("node"), F.when(F.col("there"), F.col("parent")).alias("parent")))
    counters = [F.sum(c).alias(c) for c in ("input", "cached", "written", "output", "reasoning")]
    return sessions.join(tree.withColumnRenamed("node", "thread"), "thread").groupBy(F.col("root").alias("run")).agg(*counters)
