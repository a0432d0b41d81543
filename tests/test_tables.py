"""Upserts that copy what they change, similarity joins of large buckets, requests with queries, caches by model."""

import math

import numpy as np
from pyspark.sql import functions as F

from stratalog.operators import dedup, inspect, pack, plugins, tables
from stratalog.streaming import commits

VECTORS = "project_id string, memory_id long, model_id string, vec array<double>, arrival long"


def merged(new, old):
    """upsert_embeddings, with the arrival kept."""
    found = inspect.upsert_embeddings(new.withColumn("vec", F.struct("vec", "arrival")), old.withColumn("vec", F.struct("vec", "arrival")))
    return found.select("project_id", "memory_id", "model_id", "vec.vec", "vec.arrival")


def test_upsert_touches_its_projects(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vectors")
    rows = lambda *r: spark.createDataFrame([(p, m, "m1", [v], a) for p, m, v, a in r], VECTORS)
    read = lambda **k: sorted((r.project_id, r.memory_id, r.vec[0]) for r in tables.read_table(spark, path, VECTORS, **k).collect())
    assert read() == []
    tables.upsert(rows(("1", 1, 1.0, 1), ("1", 2, 2.0, 1), ("q", 1, 3.0, 1)), path, VECTORS, merged)
    before = {str(f.relative_to(tmp_path)) for f in (tmp_path / "vectors/data").rglob("project_id=q/*.parquet")}
    assert tables.upsert(rows(("1", 2, 5.0, 2), ("1", 3, 6.0, 2)), path, VECTORS, merged) == 1
    assert read() == [("1", 1, 1.0), ("1", 2, 5.0), ("1", 3, 6.0), ("q", 1, 3.0)] and read(upto=0) == [("1", 1, 1.0), ("1", 2, 2.0), ("q", 1, 3.0)]
    after = {str(f.relative_to(tmp_path)) for f in (tmp_path / "vectors/data").rglob("project_id=q/*.parquet")}
    assert before == after and before
    # A read of one project opens its current folder only.
    own = tables.read_table(spark, path, VECTORS, projects=spark.createDataFrame([("1",)], "project_id string"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    data = next(x for x in plan.split("FileScan")[1:] if "memory_id" in x)
    assert own.count() == 3 and "(project_id#" in data.split("PartitionFilters: [")[1].split("PushedFilters")[0] and " = 1)" in data
    # A write to another project in between is kept, one to the same project makes the merge anew.
    put, other = commits.CommitLog.put, []

    def late(self, number, entry):
        if not other:
            other.append(1)
            tables.upsert(rows(("1", 4, 7.0, 3), ("z", 1, 8.0, 3)), path, VECTORS, merged)
        return put(self, number, entry)

    monkeypatch.setattr(commits.CommitLog, "put", late)
    tables.upsert(rows(("1", 1, 9.0, 4)), path, VECTORS, merged)
    other.clear()
    tables.upsert(rows(("q", 2, 4.0, 5)), path, VECTORS, merged)
    assert read() == [("1", 1, 9.0), ("1", 2, 5.0), ("1", 3, 6.0), ("1", 4, 7.0), ("q", 1, 3.0), ("q", 2, 4.0), ("z", 1, 8.0)]


def test_pairs_of_a_large_bucket(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    twin = base + noise * rng.uniform(0.1, 0.62, size=(1000, 1))
    vec = np.concatenate((base, twin / np.linalg.norm(twin, axis=1, keepdims=True)))
    df = spark.createDataFrame([(i, i % 1000 // 990, v.tolist()) for i, v in enumerate(vec)], "id long, bucket long, vec array<double>").repartition(4)
    key = lambda d: {(r.bucket, r.a, r.b, round(r.cosine, 6), r.band) for r in d.collect()}
    exact = key(dedup.dup_pairs(df))
    some = dedup.dup_pairs(df, block=64, large=500)
    found = some.collect()
    assert key(some) <= exact and len(found) == len(key(some)) and len(key(some)) >= 0.95 * len(exact) > 500
    assert {x for x in exact if x[0] == 1} == {x for x in key(some) if x[0] == 1}
    bits, n = dedup.projections(0.85, 1_000_000, 1024, 0.97)
    assert bits == 10 and n < 40


def test_nearest_in_project_and_model(spark):
    memories = spark.createDataFrame([(1, 5, "p", "m1", [1.0, 0.0], 1), (2, 5, "q", "m1", [0.0, 1.0], 2), (3, 5, "p", "m2", [0.0, 1.0], 3), (4, 5, "p", "m1", [0.6, 0.8], 4)], "id long, bucket long, project_id string, model_id string, vec array<double>, created_at long")
    asked = spark.createDataFrame([(9, 5, "p", "m1", [0.0, 1.0]), (8, 6, "p", "m1", [0.0, 1.0])], "cand_id long, bucket long, project_id string, model_id string, vec array<double>")
    assert [(r.cand_id, r.id, r.bucket_size, round(r.distance, 6)) for r in dedup.nearest_in_bucket(asked, memories).collect()] == [(9, 4, 2, 0.2)]
    assert [(r.id, r.bucket_size) for r in dedup.nearest_in_bucket(asked, memories, cap=1).collect()] == [(4, 2)]


def test_cache_by_model(spark):
    queries = spark.createDataFrame([(1, "a", "p", "m1", 1), (2, "a", "p", "m2", 1), (3, "a", "q", "m1", 1), (4, "a", "p", "m1", 2)], "query_id long, text string, project_id string, model_id string, norm_version int")
    cache = queries.where("query_id = 1").select(F.sha2("text", 256).alias("query_hash"), "project_id", "model_id", "norm_version", F.array(F.lit(1.0).cast("float")).alias("vec"))
    found, fresh = plugins.query_vectors(queries, cache, lambda texts: np.full((len(texts), 1), 7.0), 1)
    assert {r.query_id: r.vec for r in found.collect()} == {1: [1.0], 2: [7.0], 3: [7.0], 4: [7.0]} and fresh.count() == 3


def test_requests_with_queries(spark, tmp_path):
    memories = spark.createDataFrame([(1, "p", "semantic", ["a"], "alpha one"), (2, "p", "semantic", ["b"], "alpha two"), (3, "q", "semantic", ["a"], "alpha three")], "id long, project_id string, kind string, scope_keys array<string>, content string")
    memories = memories.withColumns({"trust_tier": F.lit("normal"), "valid_to": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("long")})
    embeddings = memories.select(F.col("id").alias("memory_id"), "project_id", F.array(F.lit(1.0), F.col("id") / 10).alias("vec"))
    events = spark.createDataFrame([("r", 1, "g", '{"note":"x"}', 1000)], "run_id string, seq long, agent_id string, payload string, at long").withColumn("created_at", F.timestamp_seconds("at"))
    runs = spark.createDataFrame([("r", 1, 0)], "run_id string, last_seq long, covered_seq long")
    facts = spark.createDataFrame([], "project_id string, run_id string, entity string, predicate string, value string, seq long, agent_id string")
    asked = spark.createDataFrame(
        [(1, "r", "p", "alpha", [], None, 0, 0), (2, "r", "p", "alpha", ["b"], 5, 0, 0), (3, "r", "p", "alpha", [], 1, 0, 0), (4, "x", "p", "alpha", [], 5, 0, 0), (5, "r", "p", "", [], 5, 0, 0), (6, "r", "p", "alpha", [], 5, 9, 0), (7, "r", "q", "alpha", None, None, 1, 0)],
        "pack_id long, run_id string, project_id string, query string, scopes array<string>, limit int, min_seq long, budget int",
    )
    vectors = asked.select(F.col("pack_id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.1)).alias("vec"))
    found = pack.answer_requests(asked, runs, events, facts, memories, embeddings, F.timestamp_seconds(F.lit(2000)), vectors=vectors)
    rows = {r.pack_id: (r.error_code, r.sources) for r in found.collect()}
    assert rows == {1: (None, [1, 2]), 2: (None, [2]), 3: (None, [1]), 4: ("unknown_run", None), 5: (None, []), 6: ("min_seq_ahead", None), 7: (None, [3])}
    for _ in range(2):  # a batch that is written again is there once
        pack.append_pack_log(found, str(tmp_path / "log"), 3)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5


def test_nearest_of_a_whole_bucket(spark):
    """More memories than the cap, and blocks smaller than the bucket: the nearest is the oldest one."""
    rows = [(i, 1, i, [math.cos(i / 1000), math.sin(i / 1000)]) for i in range(300)]
    memories = spark.createDataFrame(rows, "id long, bucket long, created_at long, vec array<double>")
    asked = spark.createDataFrame([(1000 + i, 1, [math.cos(i / 1000), math.sin(i / 1000)]) for i in range(0, 300, 7)], "cand_id long, bucket long, vec array<double>")
    found = dedup.nearest_in_bucket(asked, memories, cap=None, block=64).collect()
    assert sorted((r.cand_id, r.id, r.bucket_size) for r in found) == [(1000 + i, i, 300) for i in range(0, 300, 7)]
    assert min(r.id for r in dedup.nearest_in_bucket(asked, memories).collect()) == 100
