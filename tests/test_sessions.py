"""Tails, counters, limits and worker states over growing files, with restarts between."""

import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.sources import tail
from quarry.streaming import sessions

RNG = random.Random(21)


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


def usage(total, **more):
    return json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": total, "output_tokens": 1, **more}}}}).encode() + b"\n"


def test_every_line_is_read_once_whatever_the_ranges(tmp_path):
    lines = [bytes(RNG.choice(b"ab\xc3\xa9\r ") for _ in range(RNG.randrange(12))) for _ in range(200)]
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(lines) + b"\ntorn")
    for size in (1, 3, 17, 10_000):
        reader = tail.TailReader({"path": str(tmp_path), "range_bytes": str(size)})
        end = reader.latestOffset()
        got = [line for part in reader.partitions({"files": {}}, end) for line in tail.lines_of(part)]
        assert [x for _, x in got] == lines and [at for at, _ in got] == [sum(map(len, lines[:i])) + i for i in range(200)]
        assert end["files"][str(tmp_path / "a.jsonl")] == sum(map(len, lines)) + 200


def test_a_tail_resumes_and_waits_for_torn_lines(spark, tmp_path):
    logs, place = f"{tmp_path}/logs", f"{tmp_path}/place"
    read = lambda: sorted((r.value, r.at) for r in sessions.changes_of(spark, place).collect())
    put(f"{logs}/x/a.jsonl", b"one\ntw")
    put(f"{logs}/b.txt", b"not this\n")
    sessions.run_to_table(tail.tailed(spark, logs), place)
    assert read() == [("one", 0)]
    put(f"{logs}/x/a.jsonl", b"o\n\nthree\xff")
    put(f"{logs}/c.jsonl", "é\n".encode() * 3)
    sessions.run_to_table(tail.tailed(spark, logs, range_bytes=4), place)
    assert read() == sorted([("one", 0), ("two", 4), ("", 8), ("é", 0), ("é", 3), ("é", 6)])
    sessions.run_to_table(tail.tailed(spark, logs), place)
    put(f"{logs}/x/a.jsonl", b"\n")
    sessions.run_to_table(tail.tailed(spark, logs), place)
    assert ("three�", 9) in read() and len(read()) == 7


def test_session_records_reject_what_does_not_add_up(spark):
    good = [usage(10), usage(10, cached_input_tokens=4, cache_write_tokens=6), usage(5.0), usage(9, cached_input_tokens=None)]
    bad = [usage(-1), usage(1.5), usage("7"), usage(2**53), usage(3, cached_input_tokens=2, cache_write_input_tokens=2), usage(3, reasoning_output_tokens=2), usage(3, cached_input_tokens="1"), b"[]", b"{", b"", b'{"type":"event_msg","payload":3}', b"null"]
    meta = [{"id": "t", "parent_thread_id": "p"}, {"id": "u", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "q"}}}}, {"id": 3}]
    lines = good + bad + [json.dumps({"type": "session_meta", "payload": m}).encode() for m in meta]
    got = sessions.session_records(spark.createDataFrame([("f", i, x.decode()) for i, x in enumerate(lines)], "path string, at long, value string")).orderBy("at").collect()
    assert [(r.input, r.cached, r.written, r.output) for r in got if r.kind == "usage"] == [(10, 0, 0, 1), (10, 4, 6, 1), (5, 0, 0, 1), (9, 0, 0, 1)]
    assert [(r.thread, r.parent) for r in got if r.kind == "meta"] == [("t", "p"), ("u", "q"), (None, None)]


def test_counters_replace_each_other_over_restarts(spark, tmp_path):
    logs, place = f"{tmp_path}/logs", f"{tmp_path}/place"
    go = lambda: sessions.run_to_table(sessions.stateful(sessions.session_records(tail.tailed(spark, logs)), "path", sessions.LatestUsage()), place)
    put(f"{logs}/a.jsonl", json.dumps({"type": "session_meta", "payload": {"id": "root"}}).encode() + b"\n" + usage(5) + usage(9))
    put(f"{logs}/b.jsonl", json.dumps({"type": "session_meta", "payload": {"id": "child", "parent_thread_id": "root"}}).encode() + b"\n" + usage(100)[:30])
    go()
    put(f"{logs}/b.jsonl", usage(100)[30:] + b"junk\n")
    go()
    put(f"{logs}/a.jsonl", usage(20))
    put(f"{logs}/c.jsonl", json.dumps({"type": "session_meta", "payload": {"id": "other", "parent_thread_id": "elsewhere"}}).encode() + b"\n" + usage(7))
    go()
    go()
    found = sessions.current(sessions.changes_of(spark, place), "path")
    assert sorted((r.thread, r.parent, r.input) for r in found.collect()) == [("child", "root", 100), ("other", "elsewhere", 7), ("root", None, 20)]
    assert sorted((r.run, r.input) for r in sessions.run_usage(found).collect()) == [("other", 7), ("root", 120)]


def test_a_limit_stops_a_run_once(spark, tmp_path):
    rows = [(RNG.randrange(4), RNG.randrange(3), at, RNG.randrange(100)) for at in range(120)]
    known, told, stopped = defaultdict(dict), [], set()
    for run, session, _, spent in rows:
        known[run][session] = max(spent, known[run].get(session, 0))
        if sum(known[run].values()) > 150 and run not in stopped:
            stopped.add(run)
            told.append((run, session, sum(known[run].values())))
    source, place = f"{tmp_path}/in", f"{tmp_path}/place"
    for lo in range(0, 120, 40):
        spark.createDataFrame(rows[lo : lo + 40], "run long, session long, at long, spent long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("run long, session long, at long, spent long").parquet(source)
        sessions.run_to_table(sessions.stateful(stream, "run", sessions.BudgetStop(150)), place)
    got = sessions.changes_of(spark, place)
    assert sorted((r.run, r.session, r.spent) for r in got.collect()) == sorted(told) and len(told) == 4


def test_idle_keys_are_dropped(spark, tmp_path):
    source, place = f"{tmp_path}/in", f"{tmp_path}/place"
    for lo in range(3):
        spark.createDataFrame([(1, 1, lo, 100 + lo), (2 + lo, 1, lo, 1)], "run long, session long, at long, spent long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("run long, session long, at long, spent long").parquet(source)
        sessions.run_to_table(sessions.stateful(stream, "run", sessions.BudgetStop(50, idle_ms=-1)), place)
    # the run is forgotten after every batch, so it stops anew
    assert [r.run for r in sessions.changes_of(spark, place).collect()].count(1) > 1


def test_worker_reports_and_states(spark, tmp_path):
    mark = lambda **k: "WORKER_STATUS " + json.dumps(k)
    good = mark(phase="validation", planned=4, started=2)
    texts = [good, f"hi\r\n{good}\nbye", f"{good}\n{good}", mark(phase="other", planned=4, started=2), mark(phase="ranking", planned=1, started=2), mark(phase="ranking", planned=1025, started=2), mark(phase="ranking", planned=3, started=1, more=1), "WORKER_STATUS {", "WORKER_STATUS [1,2,3]", good + "x" * 70_000, mark(phase="ranking", planned=1024, started=0), None]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "session long, at long, text string")
    assert [(r.at, r.phase, r.planned, r.started) for r in sessions.worker_reports(df).orderBy("at").collect()] == [(0, "validation", 4, 2), (1, "validation", 4, 2), (10, "ranking", 1024, 0)]
    source, place = f"{tmp_path}/in", f"{tmp_path}/place"
    for lo in (0, 6):
        df.where((F.col("at") >= lo) & (F.col("at") < lo + 6)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        sessions.run_to_table(sessions.stateful(sessions.worker_reports(stream), "session", sessions.WorkerStates()), place)
    assert [(r.phase, r.planned) for r in sessions.changes_of(spark, place).orderBy("batch").collect()] == [("validation", 4), ("ranking", 1024)]
    assert [(r.session, r.phase) for r in sessions.current(sessions.changes_of(spark, place), "session").collect()] == [(1, "ranking")]


@pytest.mark.parametrize("begin", [0, 3])
def test_last_line_feed_is_found_by_blocks(tmp_path, monkeypatch, begin):
    monkeypatch.setattr(tail, "LOOK_BYTES", 4)
    (tmp_path / "f").write_bytes(b"ab\ncdefghijklm")
    with open(tmp_path / "f", "rb") as f:
        assert tail.end_of_lines(f, begin, 14) == 3


def test_threads_with_nulls_are_reduced_as_sql_does(spark, tmp_path):
    from oracle import same
    from quarry.streaming import events

    rows = [(1, 0, "user"), (1, 1, "assistant"), (1, 2, None), (2, None, "user"), (2, 0, "user"), (3, None, None), (4, 1, "assistant"), (None, 0, "assistant"), (5, 0, None), (None, 1, "user")]
    spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/w")
    (found,) = (tmp_path / "w").glob("part-*.parquet")
    found.rename(tmp_path / "conversations.parquet")
    same(spark, events.lifecycle_stream, events.ORACLES["lifecycle_stream"], str(tmp_path))


def test_streams_read_tables_of_many_files(spark, tmp_path):
    from quarry.streaming import events

    for name, key in (("conversations", "conv_id"), ("events", "event_id")):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        table.repartition(3, key).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (events.lifecycle_stream, events.high_water_stream, lambda s, d: events.budget_stream(s, d, limit=500)):
        told = sorted(map(tuple, query(spark, "/root/testdata/sf0.001").collect()))
        assert told and sorted(map(tuple, query(spark, str(tmp_path)).collect())) == told


def test_a_budget_asks_the_store_once_a_session_and_batch():
    from pyspark.sql import Row

    calls, held, total = [], {}, []

    class Counters:
        getValue = lambda self, k: calls.append(k) or (held[k],)
        containsKey = lambda self, k: calls.append(k) or k in held
        updateValue = lambda self, k, v: calls.append(k) or held.update({k: v[0]})
        clear = lambda self: held.clear()

    class Total:
        exists = lambda self: bool(total)
        get = lambda self: total[-1]
        update = total.append

    stop = sessions.BudgetStop(10_000)
    stop.counters, stop.total = Counters(), Total()
    rows = [Row(run=1, session=i % 3, at=i, spent=i) for i in range(3000)]
    random.Random(1).shuffle(rows)
    assert list(stop.step((1,), iter(rows))) == [] and total[-1] == (2997 + 2998 + 2999, False)
    assert len(calls) <= 9
    (out,) = stop.step((1,), iter([Row(run=1, session=1, at=4000, spent=5000), Row(run=1, session=2, at=4001, spent=9000)]))
    assert (out.session, out.spent) == (1, 2997 + 5000 + 2999)
    assert list(stop.step((1,), iter([Row(run=1, session=2, at=5000, spent=99_000)]))) == []
