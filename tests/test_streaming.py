"""A stream gives what one batch gives."""

from pyspark.sql import functions as F

from stratalog.operators.events import upsert_working_facts
from stratalog.streaming import streams


def test_working_state_and_marks(spark, tmp_path):
    rows = [("p", "r", "e", f"x{i % 3}", str(i), (i * 7) % 30, "a") for i in range(30)]
    df = spark.createDataFrame(rows, streams.FACT)
    for k in range(3):
        df.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(streams.FACT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    streams.stream_working_state(source(), str(tmp_path / "state"), str(tmp_path / "c1")).awaitTermination(120)
    expected = sorted(map(tuple, upsert_working_facts(df).collect()))
    assert sorted(map(tuple, streams.working_state(spark, str(tmp_path / "state")).collect())) == expected
    streams.stream_consolidate(source(), str(tmp_path / "pass"), str(tmp_path / "c2"), lambda b: {"out": b.select("run_id", "seq")}).awaitTermination(120)
    assert streams.covered_marks(spark, str(tmp_path / "pass")).first().covered_seq == 29
    # An output without its commit is not read.
    spark.createDataFrame([("r", 99)], "run_id string, covered_seq long").write.parquet(str(tmp_path / "pass/marks/batch_id=77"))
    assert streams.covered_marks(spark, str(tmp_path / "pass")).first().covered_seq == 29


def test_compaction(spark, tmp_path):
    path, into = str(tmp_path / "state"), tmp_path / "in"
    assert streams.working_state(spark, path).count() == 0
    assert streams.compact_working_state(spark, path) is None
    rows = [("p", "r", "e", f"x{i % 4}", str(i), (i * 7) % 40, "a") for i in range(40)]
    df = spark.createDataFrame(rows, streams.FACT)

    def feed(part):
        df.where(F.col("seq") % 4 == part).coalesce(1).write.mode("append").json(str(into))
        source = spark.readStream.schema(streams.FACT).option("maxFilesPerTrigger", 1).json(str(into))
        streams.stream_working_state(source, path, str(tmp_path / "c")).awaitTermination(120)

    def state():
        return sorted(map(tuple, streams.working_state(spark, path).collect()))

    feed(3), feed(0)
    before = state()
    # A snapshot that was cut off counts for nothing, and the next run replaces it.
    df.limit(1).withColumn("seq", F.lit(99).cast("long")).write.parquet(f"{path}/facts/batch_id=-2")
    assert state() == before
    assert streams.compact_working_state(spark, path) == 1 == streams.compact_working_state(spark, path)
    assert state() == before
    assert streams.committed(spark, path, "facts", streams.FACT).count() == len(before)
    feed(1), feed(2)
    expected = sorted(map(tuple, upsert_working_facts(df).collect()))
    assert state() == expected
    assert streams.compact_working_state(spark, path) == 3
    assert state() == expected


def test_live_freshness(spark, tmp_path):
    spark.createDataFrame([("r", 2, 20), ("r", 1, 10)], "run_id string, seq long, created_at long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, seq long, created_at long").json(str(tmp_path / "in"))
    q = streams.live_freshness(stream).writeStream.outputMode("complete").format("memory").queryName("lag").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert tuple(spark.table("lag").first()) == ("r", 10, 2)


def test_two_phases(spark):
    windows = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "run_id string, seq long, payload string")
    pending = streams.submit_windows(windows, lambda texts: texts.str.len().astype(str))
    assert tuple(pending.first()) == ("r", 2, "3")
    results = spark.createDataFrame([("3", 2, "x"), ("3", 9, "late")], "handle string, source_seq long, content string")
    log = spark.createDataFrame([("r", 2, "g")], "run_id string, seq long, agent_id string")
    assert [r.content for r in streams.collect_windows(pending, results, log).collect()] == ["x"]
