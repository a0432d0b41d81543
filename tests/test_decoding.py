"""Malformed parts of payloads, and operators at their limits."""

import json
import time

import pytest
from pyspark.sql import functions as F

from stratalog.operators import claims, events, extract, inspect
from stratalog.streaming import streams


def payloads(spark, *values):
    return spark.createDataFrame([(i, json.dumps(v) if not isinstance(v, str) else v) for i, v in enumerate(values)], "id int, payload string")


def test_claims_decode_as_a_whole(spark):
    good = {"entity": "db", "predicate": "port", "value": 1}
    rows = payloads(
        spark, {"claim": good}, {"claim": good | {"entity": 7}}, {"claim": good | {"predicate": ["x"]}}, {"claim": good | {"event_time": "yesterday"}}, {"claim": good | {"event_time": 5}},
        {"claim": good | {"event_time": None}}, {"claim": good | {"event_time": "2024-05-01T10:00:00Z"}}, {"claim": {"value": None}}, {"claim": good | {"entity": None, "more": 1}}, {"claim": None}, {"claim": [good]}, {"claim": "x"}, [1], "no json",
        {"claim": good | {"event_time": "2024-13-45T10:00:00Z"}},
    )
    found = {r.id: (r.entity, r.predicate, r.value, r.event_time is not None) for r in extract.extract_claims(rows).collect()}
    assert found == {0: ("db", "port", "1", False), 5: ("db", "port", "1", False), 6: ("db", "port", "1", True), 7: ("", "", "null", False), 8: ("", "port", "1", False)}


def test_entities_decode_as_a_whole(spark):
    rows = payloads(
        spark, {"entities": [{"name": "a", "type": "t", "aliases": ["x", None]}, None, {}]}, {"entities": [{"name": "a"}, {"name": 7}]}, {"entities": [{"name": "a", "aliases": "zz"}]}, {"entities": [{"name": "a", "aliases": [1]}]},
        {"entities": {"name": "a"}}, {"entities": [["a"]]}, {"entities": None}, {"entities": []}, {"entities": [{"name": "b", "aliases": None}]}, {"entities": [{"name": "b", "type": False}]}, {"note": "n"}, [{"entities": []}],
    )
    found = sorted((r.id, r.pos, r.name, r.type, r.aliases) for r in extract.extract_entities(rows).collect())
    assert found == [(0, 0, "a", "t", ["x", ""]), (0, 1, "", "", None), (0, 2, "", "", None), (8, 0, "b", "", None)]


def test_no_limit_and_no_project(spark):
    log = spark.createDataFrame([("r", i) for i in range(1, 6)], "run_id string, seq long")
    runs = spark.createDataFrame([("r", 1)], "run_id string, covered_seq long")
    assert events.uncovered_events(log, runs, None).count() == 4 and events.uncovered_events(log, runs, 2).count() == 2
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "project_id string")
    assert {r.project_id for r in inspect.drop_tenant(rows, "a").collect()} == {"b", None}


@pytest.mark.parametrize("n", [20_000])
def test_history_of_a_busy_subject(spark, n):
    rows = spark.range(n).select(
        F.lit("p").alias("project_id"), F.lit("e").alias("entity"), F.lit("x").alias("predicate"), F.col("id"), F.col("id").alias("arrival"), F.lit("r").alias("run_id"), F.col("id").alias("source_seq"),
        F.concat(F.lit('{"k'), (F.col("id") % 40).cast("string"), F.lit('":'), F.col("id").cast("string"), F.lit("}")).alias("value"),
    )
    begin = time.time()
    last = claims.merge_history(rows).orderBy(F.desc("id")).first()
    assert time.time() - begin < 60
    assert json.loads(last.value) == {f"k{i % 40}": i for i in range(n - 40, n)} and last.superseded_by is None


def test_compaction_leaves_later_batches(spark, tmp_path, monkeypatch):
    """A batch that commits while a snapshot is written counts once, also for folds that add up."""
    path, schema = str(tmp_path), "key string, n long"
    total = lambda df: df.groupBy("key").agg(F.sum("n").alias("n"))

    def commit(batch, n):
        spark.createDataFrame([("a", n)], schema).write.parquet(f"{path}/sums/batch_id={batch}")
        spark.createDataFrame([(batch,)], "batch_id long").coalesce(1).write.mode("append").json(f"{path}/commits")

    commit(0, 1), commit(1, 2)
    seen = streams._batches

    def late(s, p):
        found = seen(s, p)
        if not (tmp_path / "sums/batch_id=2").exists():
            found = s.createDataFrame(found.collect(), "batch_id long")
            commit(2, 4)
        return found

    monkeypatch.setattr(streams, "_batches", late)
    assert streams.compact(spark, path, "sums", schema, total) == 1
    assert total(streams.committed(spark, path, "sums", schema)).first().n == 7
