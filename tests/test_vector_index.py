"""The index path of vector search against the exact one."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.operators import retrieve, vector_index
from stratalog.sources import adapters

SF = "/root/testdata/sf0.01"


def clustered(spark, n=3000, groups=30):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(groups, 16))
    vecs = centers[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, 16))
    vecs[0] = 0
    rows = [(i, f"p{i % 2}", "m1", [f"s{i % 10}"], v.tolist()) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "id long, project_id string, model_id string, scope_keys array<string>, vec array<double>").repartition(4)


def test_clustered_vectors(spark, tmp_path):
    vectors = clustered(spark)
    path = str(tmp_path / "index")
    vector_index.write_index(vectors, path, cells=30)
    centroids = vector_index.read_centroids(spark, path)
    index = spark.read.parquet(f"{path}/cells")
    assert index.count() == 3000 and len(centroids) == 30
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "project_id", "model_id", "vec", F.when(F.col("id") % 40 == 0, F.array(F.lit("s0"))).otherwise(F.array().cast("array<string>")).alias("scopes"))
    exact = retrieve.dense_topk(asked, vectors, 20)
    found = vector_index.index_topk(asked, path, 20, passing=asked.select("query_id", F.lit(150).alias("n")))
    shares = vector_index.recall(found, exact).agg(F.avg("recall").alias("mean"), F.count("*").alias("n")).first()
    assert shares.mean >= 0.95 and shares.n == 150
    # A few cells are enough, and the scan lists only those.
    few = {r.neighbours: r.probes for r in spark.read.parquet(f"{path}/probes").collect()}
    assert few[32] <= 4
    one = vector_index.index_topk(asked.where("query_id = 20").drop("scopes"), path, 20)
    assert vector_index.recall(one, retrieve.dense_topk(asked.where("query_id = 20").drop("scopes"), vectors, 20)).first().recall == 1
    # All cells are the exact search.
    every = vector_index.index_topk(asked, path, 20, probes=30)
    key = lambda df: sorted((r.query_id, r.pos, r.id) for r in df.collect())
    assert key(every) == key(exact)


def test_probes_widen(spark, tmp_path):
    """A rare scope makes queries probe on until they have k rows, or all cells."""
    vectors = clustered(spark).withColumn("scope_keys", F.when(F.col("id") % 500 == 7, F.array(F.lit("rare"))).otherwise(F.col("scope_keys")))
    path = str(tmp_path / "index")
    vector_index.write_index(vectors, path, cells=30)
    asked = vectors.where("id IN (40, 60)").select(F.col("id").alias("query_id"), "model_id", "vec", F.array(F.lit("rare")).alias("scopes"))
    found = vector_index.index_topk(asked, path, 5, probes=1)
    key = lambda df: sorted((r.query_id, r.pos, r.id) for r in df.collect())
    assert found.count() == 10 and all(r.id % 500 == 7 for r in found.collect())
    assert key(vector_index.index_topk(asked, path, 20, probes=1)) == key(retrieve.dense_topk(asked, vectors, 20))


def test_hybrid_takes_the_index_leg(spark, tmp_path):
    memories, embeddings, asked = (f(spark, SF) for f in (adapters.memories, adapters.embeddings, adapters.search_queries))
    path = str(tmp_path / "index")
    vector_index.write_index(embeddings.withColumnRenamed("memory_id", "id"), path)
    leg = vector_index.dense_leg(asked, memories, path, limit=1, probes=10_000)
    key = lambda df: sorted((r.query_id, r.pos, r.id) for r in df.collect())
    assert key(retrieve.hybrid_retrieve(asked, memories, embeddings, dense=leg)) == key(retrieve.hybrid_retrieve(asked, memories, embeddings))


def test_no_vectors(spark, tmp_path):
    with pytest.raises(ValueError):
        vector_index.write_index(clustered(spark).limit(0), str(tmp_path / "index"))


def exchanged(spark, run):
    """Rows that the stages of `run` write for exchanges."""
    sc = spark.sparkContext
    empty = sc._jvm.java.util.ArrayList()

    def stages():
        time.sleep(1)  # the store of stages follows a bus of events
        found = sc._jsc.sc().statusStore().stageList(empty, False, False, sc._gateway.new_array(sc._jvm.double, 0), empty)
        return [found.apply(i) for i in range(found.size())]

    last = max(s.stageId() for s in stages())
    run()
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > last)


def test_rows_of_a_search_do_not_grow_with_cells(spark, tmp_path):
    """A query keeps its k best of all cells in a block of vectors, and not of each cell or each file."""
    vectors = clustered(spark)
    path = str(tmp_path / "index")
    vector_index.write_index(vectors, path, cells=30)
    index, centroids = spark.read.parquet(f"{path}/cells"), vector_index.read_centroids(spark, path)
    asked = vectors.where("id % 2 = 0").select(F.col("id").alias("query_id"), "project_id", "model_id", "vec", F.array().cast("array<string>").alias("scopes"))
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # what Spark leaves out itself, it has sorted before
    try:
        assert exchanged(spark, lambda: vector_index.index_topk(asked, path, 5, probes=30).count()) < 1500 * (2 * 5 + 10)
    finally:
        spark.conf.set(key, before)
    assert exchanged(spark, lambda: vector_index.needed_probes(index, centroids, most=1001)) < 250 * 1001


def test_blocks_of_cells(spark, tmp_path, monkeypatch):
    """Several blocks and rows of queries, with few cells and with many, against brute force over the probed cells."""
    vectors = clustered(spark)
    path = str(tmp_path / "index")
    vector_index.write_index(vectors, path, cells=30)
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 20)
    centroids, rows = vector_index.read_centroids(spark, path), spark.read.parquet(f"{path}/cells").collect()
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)
    ids, cell, scope, vecs = np.array([r.id for r in rows]), np.array([r.cell for r in rows]), np.array([r.scope_keys[0] for r in rows]), unit(np.array([r.vec for r in rows]))
    asked = vectors.where("id % 30 = 1").select(F.col("id").alias("query_id"), "project_id", "vec", F.when(F.col("id") % 4 == 1, F.array(F.lit("s1"), F.lit("s3"))).alias("scopes"))
    for probes in (2, 27):
        expected = []
        for q in asked.collect():
            near = np.argsort(-(centroids @ unit(np.array(q.vec))).round(9), kind="stable")[:probes]
            seen = np.flatnonzero((ids % 2 == q.query_id % 2) & np.isin(cell, near) & (np.isin(scope, q.scopes) if q.scopes else True))
            distance = (1 - vecs[seen] @ unit(np.array(q.vec))).round(9)
            assert len(seen) >= 3
            expected += [(q.query_id, n + 1, int(ids[seen[i]])) for n, i in enumerate(np.lexsort((ids[seen], distance))[:3])]
        assert sorted((r.query_id, r.pos, r.id) for r in vector_index.index_topk(asked, path, 3, probes=probes).collect()) == sorted(expected)
