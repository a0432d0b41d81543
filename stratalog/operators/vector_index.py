"""An inverted file of vectors: every vector lies in the cell of its nearest centroid, cells are stored as partitions,
and a search reads the cells nearest to its queries, more of them where filters leave too few rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stratalog.sources.shared import stored

from .retrieve import DEPTH, EXACT_LIMIT, candidate_count, dense_topk, exclude_quarantine, live_head

#: Vectors that the centroids are fitted to, and cells of an index, at most.
SAMPLE, MOST_CELLS = 50_000, 4096
#: Share of the nearest neighbours that probes are to find, by an exact search for about ASKED stored vectors for up to
#: NEIGHBOURS neighbours each.
TARGET, ASKED, NEIGHBOURS = 0.98, 200, 4096


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def fit_cells(vectors: DataFrame, cells: int, *, sample: int = SAMPLE, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """Centroids of at most `cells` cells by spherical k-means over at most about `sample` vectors, which a hash of
    their ids picks; vectors of length 0 are left out."""
    n = vectors.count()
    share = min(1.0, sample / max(n, 1))
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.col("vec").cast("array<double>").alias("vec"))
    picked = picked.where(F.exists("vec", lambda x: x != 0)).select(array_to_vector("vec").alias("features")).persist()
    try:
        if picked.isEmpty():
            return np.ones((1, 1))
        model = KMeans(k=min(cells, MOST_CELLS), distanceMeasure="cosine", seed=seed, maxIter=rounds).fit(picked)
        return _unit(np.array(model.clusterCenters()))
    finally:
        picked.unpersist()


def with_cell(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of `vectors` with the cell of the nearest centroid; the first of equally near ones."""
    kept = vectors.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = np.stack([np.asarray(v, dtype=np.float64) for v in batch.column("vec").to_pylist()])
                cell = np.argmax((_unit(table) @ centroids.T).round(9), axis=1) if centroids.shape[1] == table.shape[1] else np.zeros(len(table))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*kept, "cell"])

    return vectors.mapInArrow(assign, StructType([*vectors.schema.fields, StructField("cell", IntegerType())]))


def _nearest_cells(centroids: np.ndarray):
    """A column function: the cells in order of nearness to a vector."""

    def order(vecs: pd.Series) -> pd.Series:
        table = _unit(np.stack(vecs.to_numpy()).astype(np.float64))
        near = (table @ centroids.T).round(9) if table.shape[1] == centroids.shape[1] else np.zeros((len(table), len(centroids)))
        return pd.Series(list(np.argsort(-near, axis=1, kind="stable").astype(np.int32)))

    return F.pandas_udf(order, "array<int>")


def needed_probes(index: DataFrame, centroids: np.ndarray, *, target: float = TARGET, asked: int = ASKED, most: int = NEIGHBOURS) -> list[tuple[int, int]]:
    """(neighbours, cells): how many of its nearest cells hold, on average, `target` of a vector's nearest neighbours,
    for 1, 2, 4, ... neighbours; from an exact search for about `asked` stored vectors, which a hash picks."""
    n = index.count()
    picked = index.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < int(min(1.0, asked / max(n, 1)) * (1 << 20)) + 1)
    picked = stored(picked.select(F.monotonically_increasing_id().alias("query_id"), "vec").withColumn("_order", _nearest_cells(centroids)("vec")), "picked")
    numbered = index.select("cell", F.col("vec"), F.xxhash64("id", "cell").alias("id"))
    near = dense_topk(picked.select("query_id", "vec"), numbered, min(most, max(n, 1))).select("query_id", "id", "pos")
    placed = near.join(numbered.select("id", "cell"), "id").join(picked.select("query_id", "_order"), "query_id")
    placed = placed.select("pos", F.array_position("_order", F.col("cell")).alias("rank"))
    level = F.ceil(F.log2("pos")).cast("int")
    counts = placed.groupBy(level.alias("level"), "rank").agg(F.count("*").alias("n")).collect()  # cells times levels at most
    table = np.zeros((max((r.level for r in counts), default=0) + 1, len(centroids) + 1))
    for r in counts:
        table[r.level, r.rank] += r.n
    whole = np.cumsum(np.cumsum(table, axis=0), axis=1)
    return [(1 << level, int(np.searchsorted(row, target * row[-1]))) for level, row in enumerate(whole)]


def write_index(vectors: DataFrame, path: str, *, cells: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> None:
    """Writes all vectors (id, vec, project_id, model_id, ...) by cell, the centroids, and how many cells to probe. By
    default there is about one cell for each square root of their number. A large cell becomes several files, as Spark
    splits skewed partitions of a rebalanced table. Without vectors there is no index, and an error tells."""
    spark, n = vectors.sparkSession, vectors.count()
    if not n:
        raise ValueError("an index needs vectors")
    centroids = fit_cells(vectors, cells or max(1, min(MOST_CELLS, int(n**0.5))), sample=sample)
    with_cell(vectors, centroids).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    needed = needed_probes(spark.read.parquet(f"{path}/cells"), centroids, target=target)
    spark.createDataFrame(needed, "neighbours long, probes int").withColumn("rows", F.lit(n)).coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")


def read_centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
    return np.array([r.center for r in rows])


def index_topk(queries: DataFrame, path: str, k: int = DEPTH, *, visible: DataFrame | None = None, passing: DataFrame | None = None, probes: int | None = None) -> DataFrame:
    """query_id, id, distance, pos as dense_topk gives them, from the cells that each query probes.

    `visible` (id, and project_id and scope_keys where it has them) are the rows that may be found; filters are as in
    dense_topk. If the filters leave one row in ten, the k nearest of them lie among some 10 k nearest of all: so
    `passing` (query_id, n: the rows that pass a query's filters) tells how many cells to probe, by what was measured
    when the index was written; `probes` overrides it. A query that found fewer than k rows probes twice as many cells,
    until it has enough or has probed all. Rows of probed cells are compared exactly, and only their partitions are
    read.
    """
    spark = queries.sparkSession
    centroids = read_centroids(spark, path)
    index = spark.read.parquet(f"{path}/cells")
    if visible is not None:
        keys = ["id", *(["project_id"] if "project_id" in visible.columns and "project_id" in index.columns else [])]
        allowed = visible.select(*keys, *([F.col("scope_keys")] if "scope_keys" in visible.columns else []))
        # Ids are stored in few bytes and take many in memory, so their files' size must not make them a broadcast.
        index = (index.drop("scope_keys") if "scope_keys" in visible.columns else index).join(allowed.hint("merge"), keys)
    needed = spark.read.parquet(f"{path}/probes").orderBy("neighbours").collect()  # one row for each power of two
    asked, order = queries, _nearest_cells(centroids)("vec")
    if probes is not None:
        asked = asked.withColumn("_width", F.lit(probes))
    else:
        rows = F.col("_n") if passing is not None else F.lit(needed[0].rows)
        among = k * needed[0].rows / F.greatest(rows, F.lit(1))
        steps = F.lit(len(centroids))
        for r in reversed(needed):
            steps = F.when(among <= r.neighbours, r.probes).otherwise(steps)
        if passing is not None:
            asked = asked.join(passing.select("query_id", F.col("n").alias("_n")), "query_id", "left").fillna({"_n": 0})
        asked = asked.withColumn("_width", steps)
    asked = stored(asked.withColumns({"_from": F.lit(0), "_width": F.least(F.greatest("_width", F.lit(1)), F.lit(len(centroids)))}).drop("_n"), "asked")
    found = None
    while True:
        # A query goes along once, with its cells, and not once for each of them.
        probed = asked.withColumn("cells", F.slice(order, F.col("_from") + 1, F.col("_width") - F.col("_from"))).drop("_from", "_width")
        # Names of cells, MOST_CELLS at most, choose the partitions that the scan lists.
        cells = [r.cell for r in probed.select(F.explode("cells").alias("cell")).distinct().collect()]
        near = stored(dense_topk(probed, index.where(F.col("cell").isin(cells)), k).drop("pos"), "probed")
        found = near if found is None else found.unionByName(near)
        pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
        best = found.withColumn("pos", pos).where(F.col("pos") <= k)
        full = best.groupBy("query_id").count().where(F.col("count") >= k)
        asked = asked.where(F.col("_width") < len(centroids)).join(full, "query_id", "left_anti")
        asked = stored(asked.withColumn("_from", F.col("_width")).withColumn("_width", F.least(2 * F.col("_width"), F.lit(len(centroids)))), "asked")
        if asked.isEmpty():
            return best


def dense_leg(queries: DataFrame, memories: DataFrame, path: str, k: int = DEPTH, *, limit: int = EXACT_LIMIT, probes: int | None = None) -> DataFrame:
    """The dense leg by the path of each query: an exact pass for those whose filters leave at most `limit` memories, the
    index for the others. query_id, id, distance, pos, path."""
    live = stored(exclude_quarantine(live_head(memories)).select("id", "project_id", "scope_keys"), "live")
    counts = stored(candidate_count(queries, live, (1 << 62)).select("query_id", "n"), "counts")
    routed = queries.join(counts.select("query_id", F.when(F.col("n") <= limit, "exact").otherwise("index").alias("path")), "query_id")
    index = queries.sparkSession.read.parquet(f"{path}/cells").drop("cell", "scope_keys")
    # Memories without a vector go once, and not in each search.
    held = stored(live.join(index.select("id", "project_id").hint("merge"), ["id", "project_id"], "left_semi"), "held")
    exact = dense_topk(routed.where("path = 'exact'").drop("path"), index.join(held.hint("merge"), ["id", "project_id"]), k).withColumn("path", F.lit("exact"))
    many = routed.where("path = 'index'").drop("path")
    return exact.unionByName(index_topk(many, path, k, visible=held, passing=counts, probes=probes).withColumn("path", F.lit("index")))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query the share of the exact neighbours that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("recall"), F.count("*").alias("neighbours"))
