"""Guarded commits, stateful streams and the ledger, over restarts and repeated work."""

import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratalog.operators import fold
from stratalog.streaming import commits, ledger, stateful


def feed(df, path):
    df.coalesce(1).write.mode("append").json(str(path))


def memory(stream, name, checkpoint, mode="append", **trigger):
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(**(trigger or {"availableNow": True})).start()


def test_one_of_two_passes_counts(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda who, *runs: {"out": spark.createDataFrame([(r, who) for r in runs], "run_id string, who string")}
    marks = lambda *m: spark.createDataFrame(list(m), commits.MARKS)
    base = spark.createDataFrame([("c", 7)], "run_id string, covered_seq long")
    read = lambda: sorted(map(tuple, commits.guarded_rows(spark, path, "out", "run_id string, who string").collect()))
    assert read() == [] and commits.guarded_marks(spark, path, base).count() == 1
    one = commits.commit_pass(rows("x", "a", "b"), marks(("a", 0, 5), ("b", 0, 3)), path, name="one", base=base)
    assert one.count() == 2
    # Another pass over the same window of a, and one of c from its base mark; then one from a wrong mark only.
    assert [r.run_id for r in commits.commit_pass(rows("y", "a", "c"), marks(("a", 0, 5), ("c", 7, 9)), path, base=base).collect()] == ["c"]
    assert commits.commit_pass(rows("z", "b"), marks(("b", 2, 8)), path, base=base).isEmpty()
    assert commits.commit_pass(rows("again", "a"), marks(("a", 0, 5)), path, name="one", base=base).count() == 2
    assert read() == [("a", "x"), ("b", "x"), ("c", "y")]
    assert sorted(map(tuple, commits.guarded_marks(spark, path, base).collect())) == [("a", 5), ("b", 3), ("c", 9)]


def test_a_writer_that_comes_between(spark, tmp_path, monkeypatch):
    """An entry that another writer puts first makes the pass look at the marks again."""
    path = str(tmp_path / "out")
    marks = lambda *m: spark.createDataFrame(list(m), commits.MARKS)
    out = lambda who: {"out": spark.createDataFrame([("a", who), ("b", who)], "run_id string, who string")}
    put, other = commits.CommitLog.put, []

    def late(self, number, entry):
        if not other:
            other.append(1)
            commits.commit_pass(out("first"), marks(("a", 0, 4)), path)
        return put(self, number, entry)

    monkeypatch.setattr(commits.CommitLog, "put", late)
    found = commits.commit_pass(out("second"), marks(("a", 0, 4), ("b", 0, 6)), path)
    assert [tuple(r) for r in found.collect()] == [("b", 6)]
    assert sorted(map(tuple, commits.guarded_rows(spark, path, "out", "run_id string, who string").collect())) == [("a", "first"), ("b", "second")]


def test_two_streams_of_one_log(spark, tmp_path):
    schema, path = "run_id string, seq long", str(tmp_path / "out")
    feed(spark.createDataFrame([("r", i) for i in range(1, 6)], schema), tmp_path / "in")
    source = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    make = lambda b: {"out": b.select("run_id", "seq")}
    for writer in ("one", "two"):
        commits.stream_guarded(source(), path, str(tmp_path / writer), make, writer=writer).awaitTermination(120)
    feed(spark.createDataFrame([("r", i) for i in range(6, 8)], schema), tmp_path / "in")
    for writer in ("two", "one"):
        commits.stream_guarded(source(), path, str(tmp_path / writer), make, writer=writer).awaitTermination(120)
    assert sorted(r.seq for r in commits.guarded_rows(spark, path, "out", schema).collect()) == list(range(1, 8))


def test_windows_that_are_due(spark, tmp_path):
    """A burst hands over full windows, what is left stays over a restart, and the timer brings it."""
    schema = "run_id string, seq long, payload string"
    rows = lambda run, first, last: [(run, i, f"e{i}") for i in range(first, last + 1)]
    source = lambda idle: stateful.due_windows(spark.readStream.schema(schema).json(str(tmp_path / "in")), most=4, idle_ms=idle, window=10)

    def sizes(name):
        return sorted((r.run_id, r.pass_no, r.cause, r["count"]) for r in spark.table(name).groupBy("run_id", "pass_no", "cause").count().collect())

    sink = str(tmp_path / "sink")
    run = lambda idle, **t: source(idle).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "c")).trigger(**t).start()
    feed(spark.createDataFrame(rows("a", 1, 25) + rows("b", 1, 3) + rows("c", 1, 22), schema), tmp_path / "in")
    run(3_600_000, availableNow=True).awaitTermination(120)
    spark.read.schema(stateful.WINDOW).parquet(sink).createOrReplaceTempView("due")
    assert sizes("due") == [("a", 1, "count", 10), ("a", 2, "count", 10), ("a", 3, "count", 5), ("c", 1, "count", 10), ("c", 2, "count", 10)]
    feed(spark.createDataFrame(rows("b", 4, 4) + rows("a", 26, 26) + rows("c", 23, 23), schema), tmp_path / "in")
    q = run(1_500, processingTime="300 milliseconds")
    try:
        end = time.time() + 90
        while time.time() < end and len(sizes("due")) < 8:
            time.sleep(1)
            spark.read.schema(stateful.WINDOW).parquet(sink).createOrReplaceTempView("due")
    finally:
        q.stop()
    assert sizes("due")[3:] == [("a", 4, "idle", 1), ("b", 1, "count", 4), ("c", 1, "count", 10), ("c", 2, "count", 10), ("c", 3, "idle", 3)]
    seqs = sorted((r.run_id, r.seq) for r in spark.table("due").collect())
    assert seqs == sorted([("a", i) for i in range(1, 27)] + [("b", i) for i in range(1, 5)] + [("c", i) for i in range(1, 24)])


def test_lag_falls_when_the_mark_passes(spark, tmp_path):
    log, marks = "run_id string, seq long, created_at timestamp", "run_id string, covered_seq long"
    event = lambda run, seq: (run, seq, pd.Timestamp(1000 + seq, unit="s").to_pydatetime())
    source = lambda: stateful.live_lag(spark.readStream.schema(log).json(str(tmp_path / "e")), spark.readStream.schema(marks).json(str(tmp_path / "m")))
    feed(spark.createDataFrame([], marks), tmp_path / "m")

    def step(name, events, moved):
        if events:
            feed(spark.createDataFrame([event(*x) for x in events], log), tmp_path / "e")
        if moved:
            feed(spark.createDataFrame(moved, marks), tmp_path / "m")
        found = []
        q = source().writeStream.outputMode("update").foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.run_id, r.covered_seq, r.pending, r.oldest and r.oldest.timestamp()) for r in found)

    assert [x[:3] for x in step("a", [("r", 2), ("r", 1), ("r", 3), ("s", 1)], [])] == [("r", 0, 3), ("s", 0, 1)]
    second = step("b", [("r", 4)], [("r", 2)])
    assert second[-1][:3] == ("r", 2, 2)
    assert step("c", [], [("r", 4), ("s", 9)]) == [("r", 4, 0, None), ("s", 9, 0, None)]
    assert step("d", [("s", 8), ("r", 5)], [("r", 1)])[-1][:3] == ("s", 9, 0)


def test_streamed_fold_equals_batch(spark, tmp_path):
    rng, schema = random.Random(3), "project_id string, context_hash string, content_hash string, arrival long, id long, vec array<double>"
    rows = []
    for i in range(90):
        angle = rng.choice([0.0, 0.1, 0.62, 1.2, 1.25, 2.0])
        rows.append((f"p{i % 2}", f"c{rng.randint(0, 1)}", f"{angle}", i, i, [float(np.cos(angle)), float(np.sin(angle))]))
    rows = [(p, c, f"{c}{h}", *rest) for p, c, h, *rest in rows]
    df = spark.createDataFrame(rows, schema)
    found = []
    for k in range(3):  # a restart between each two parts
        feed(df.where((F.col("id") >= 30 * k) & (F.col("id") < 30 * k + 30)), tmp_path / "in")
        stream = stateful.stream_fold(spark.readStream.schema(schema).json(str(tmp_path / "in")), cap=2)
        stream.writeStream.outputMode("append").foreachBatch(lambda b, _: found.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    key = lambda r: (r.id, r.outcome, r.memory_id, r.gray, r.version, r.replaced_id, r.live_id)
    want = sorted(map(key, fold.fold_candidates(df, cap=2).collect()))
    assert sorted(map(key, found)) == want and {x[1] for x in want} == {"inserted", "exact_merged", "near_merged"}


def test_ledger(spark, tmp_path):
    path, calls = str(tmp_path / "ledger"), spark.sparkContext.accumulator(0)
    events = spark.createDataFrame([("r", i, f"x{i}") for i in range(1, 6)] + [("s", 1, "y")], "run_id string, seq long, payload string")

    def send(keys, texts):
        calls.add(len(keys))
        return keys.map(lambda k: f"h-{k}")

    def broken(keys, texts):
        raise RuntimeError("the extractor is away")

    try:
        ledger.submit(events, path, broken, window=3)
    except Exception as e:  # noqa: BLE001
        assert "the extractor is away" in str(e)
    assert ledger.in_flight(spark, path).count() == 0
    assert sorted((r.key, r.handle) for r in ledger.submit(events, path, send, window=3).collect()) == [("r:0:3", "h-r:0:3"), ("s:0:1", "h-s:0:1")]
    # Once more, as after a crash, and with later events: nothing is in flight twice.
    assert ledger.submit(events, path, send, window=3).count() == 2 and calls.value == 2
    # A job that was run again before its rows were known wrote the same handle; it stays one window.
    ledger.in_flight(spark, path).write.mode("append").parquet(f"{path}/sent")
    assert ledger.in_flight(spark, path).count() == 2
    results = spark.createDataFrame([("h-r:0:3", 2, "two"), ("h-r:0:3", 9, "late"), ("h-s:0:1", 1, "s")], "handle string, source_seq long, content string")
    states = spark.createDataFrame([("h-r:0:3", "done"), ("h-s:0:1", "running")], "handle string, state string")
    assert [tuple(r) for r in ledger.collect(results, states, path).collect()] == [("r", 3)]
    assert ledger.collect(results, states, path).isEmpty()
    read = lambda: sorted((r.run_id, r.source_seq, r.content) for r in commits.guarded_rows(spark, path, "candidates", "run_id string, source_seq long, content string, key string").collect())
    assert read() == [("r", 2, "two")]
    failed = spark.createDataFrame([("h-s:0:1", "failed")], "handle string, state string")
    assert ledger.collect(results, failed, path).isEmpty() and ledger.in_flight(spark, path).count() == 0
    assert sorted(r.key for r in ledger.submit(events, path, send, window=3).collect()) == ["r:3:5", "s:0:1:1"]
    more = spark.createDataFrame([("h-s:0:1:1", 1, "s"), ("h-r:3:5", 5, "five")], "handle string, source_seq long, content string")
    assert ledger.collect(more, more.select("handle", F.lit("done").alias("state")), path).count() == 2
    assert read() == [("r", 2, "two"), ("r", 5, "five"), ("s", 1, "s")]
