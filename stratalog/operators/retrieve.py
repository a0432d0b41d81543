"""Retrieval for many queries at once: vector and text search, rank fusion, reranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from stratalog.functions.text import quantize, scope_overlap
from stratalog.sources.shared import stored

from .textsearch import DEPTH, text_topk

EXACT_LIMIT, RRF_K, RERANK_DEPTH, LIMIT = 8000, 60, 50, 20
#: Queries whose vectors are sent to all tasks at a time.
QUERY_BLOCK = 2_000
#: Bytes of a block of vectors.
BLOCK_BYTES = 8 << 20
#: Bytes of the distances that a task computes at a time.
PRODUCT_BYTES = 32 << 20


def live_head(memories: DataFrame) -> DataFrame:
    return memories.where("superseded_by IS NULL AND valid_to IS NULL")


def exclude_quarantine(memories: DataFrame, include: bool = False) -> DataFrame:
    return memories if include else memories.where("trust_tier <> 'quarantine'")


def with_vectors(memories: DataFrame, embeddings: DataFrame, model_id: str | None = None) -> DataFrame:
    """Memories with the vectors that belong to their id (and project, where both sides name it)."""
    vectors = embeddings if model_id is None else embeddings.where(F.col("model_id") == model_id)
    keys = ["id", *(["project_id"] if "project_id" in embeddings.columns and "project_id" in memories.columns else [])]
    return memories.join(vectors.withColumnRenamed("memory_id", "id"), keys)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


@F.pandas_udf(BinaryType())
def _bits(cells: pd.Series) -> pd.Series:
    """A bit for each cell: numbers of cells are many, and rows of queries go to many tasks."""
    return cells.map(lambda c: np.packbits(np.bincount(c).astype(bool), bitorder="little").tobytes())


def _vec(df: DataFrame):
    """The column vec as it is stored, floats or else doubles, and the bytes of a number."""
    floats = df.schema["vec"].dataType.simpleString() == "array<float>"
    return F.col("vec").cast("array<float>" if floats else "array<double>").alias("vec"), 4 if floats else 8


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = DEPTH) -> DataFrame:
    """query_id, id, distance, pos: the k nearest of `vectors` (id, vec) by cosine distance, ties by id.

    A query sees only vectors of its project_id and model_id, where both sides have these columns, where it has scopes,
    those whose scope_keys share one with them, and where it has `cells` (array<int>), those whose cell is among them.
    The vectors of a project and model are dealt by id into as many blocks of BLOCK_BYTES as they fill, queries (a stated
    set) into rows of QUERY_BLOCK at most. A vector is exchanged once, to its block, and a row of queries goes to each
    block. Pairs of a block and a row arise in the task of the block and are not exchanged; each is handed over on its
    own and keeps its k best per query, so the last exchange holds k rows per query and block at most.
    """
    keys = [c for c in ("project_id", "model_id") if c in queries.columns and c in vectors.columns]
    scoped, celled = "scopes" in queries.columns and "scope_keys" in vectors.columns, "cells" in queries.columns and "cell" in vectors.columns
    none = F.array().cast("array<string>")
    vec, _ = _vec(queries)
    asked = queries.select("query_id", vec, (F.coalesce("scopes", none) if scoped else none).alias("scopes"), (_bits("cells") if celled else F.lit(b"")).alias("bits"), *keys, F.lit(0).alias("_all"))
    keys = keys or ["_all"]
    vec, width = _vec(vectors)
    rows = vectors.select("id", vec, (F.coalesce("scope_keys", none) if scoped else none).alias("scope_keys"), (F.col("cell").cast("int") if celled else F.lit(0)).alias("cell"), *[F.lit(0).alias(c) if c == "_all" else F.col(c) for c in keys])
    # Both sides have to know the same number of blocks, so it is stored.
    sizes = asked.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("_rows"), F.max(F.size("vec")).alias("_dim")).join(rows.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    sizes = stored(sizes.select(*keys, "_rows", F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("_dim") * width / BLOCK_BYTES)).cast("int").alias("_blocks")), "sizes")
    packed = asked.join(sizes, keys).withColumn("_row", F.pmod(F.xxhash64("query_id"), F.col("_rows")))
    on = [*(c for c in keys if c != "_all"), "_block"]
    packed = packed.groupBy(*on[:-1], "_blocks", "_row").agg(F.collect_list(F.struct("query_id", "vec", "scopes", "bits")).alias("_q"))
    packed = packed.select(*on[:-1], "_row", F.col("_q.query_id"), F.flatten("_q.vec").alias("asked"), F.col("_q.scopes"), F.col("_q.bits"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    blocks = rows.join(sizes.drop("_rows"), keys).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    blocks = blocks.groupBy(*on).agg(F.collect_list(F.struct("id", "vec", "scope_keys", "cell")).alias("_v"))
    blocks = blocks.select(*on, F.col("_v.id"), F.flatten("_v.vec").alias("vecs"), F.col("_v.scope_keys"), F.col("_v.cell"))

    def search(pair: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "id": [], "distance": []})]
        for r in pair.itertuples():
            ids, query = np.asarray(r.id), np.asarray(r.query_id)
            table, asked = (_unit(np.asarray(v, dtype=np.float64).reshape(n, -1)) for v, n in ((r.vecs, len(ids)), (r.asked, len(query))))
            wanted = [tuple(x) for x in r.scopes]
            allowed = {x: np.array([not set(h).isdisjoint(x) for h in r.scope_keys]) for x in set(wanted) - {()}}
            step = max(1, PRODUCT_BYTES // (8 * len(ids)))
            parts = [np.arange(at, min(at + step, len(query))) for at in range(0, len(query), step)]
            if celled:
                cells, cell, count = np.unique(r.cell, return_inverse=True, return_counts=True)
                probed = np.zeros((len(query), cells[-1] + 1), dtype=bool)
                for i, b in enumerate(r.bits):
                    flags = np.unpackbits(np.frombuffer(b, dtype=np.uint8), bitorder="little")[: probed.shape[1]]
                    probed[i, : len(flags)] = flags
                probed = probed[:, cells]
                # Queries with few cells in common are searched one by one.
                sparse = [probed[p].any(axis=0) @ count * len(p) > 4 * (probed[p] @ count).sum() for p in parts]
                parts = [x for p, alone in zip(parts, sparse, strict=True) for x in (p.reshape(-1, 1) if alone else [p])]
            for some in parts:
                place = np.flatnonzero(probed[some].any(axis=0)[cell]) if celled else np.arange(len(ids))
                if not len(place):
                    continue
                whole = len(place) == len(ids)
                distance = 1 - asked[some] @ (table if whole else table[place]).T
                if celled and len(some) > 1:
                    distance[~probed[some][:, cell[place]]] = np.inf
                for i, q in enumerate(some):
                    if wanted[q]:
                        distance[i, ~allowed[wanted[q]][place]] = np.inf
                coarse, most, own = distance.round(9), min(k, len(place)), ids[place]
                # All that is as near as the k-th; ties beyond it are settled by id.
                row, at = np.nonzero((coarse <= np.partition(coarse, most - 1, axis=1)[:, most - 1 : most]) & np.isfinite(coarse))
                order = np.lexsort((own[at], coarse[row, at], row))
                row, at = row[order], at[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < most
                row, at = row[keep], at[keep]
                found.append(pd.DataFrame({"query_id": query[some[row]], "id": own[at], "distance": distance[row, at]}))
        return pd.concat(found[1:] or found)

    # Dealt out by the keys of the join, pairs lie together already. A pair is a group: Python has no more at a time.
    pairs = blocks.hint("shuffle_hash").join(packed, on).groupBy(*on, "_row")
    found = pairs.applyInPandas(search, "query_id long, id long, distance double")
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
    return found.withColumn("pos", pos).where(F.col("pos") <= k)


def candidate_count(queries: DataFrame, memories: DataFrame, limit: int = EXACT_LIMIT) -> DataFrame:
    """Per query (query_id, project_id, scopes) how many memories its filters leave, counted to limit + 1, and the path:
    one pass over them (exact), or one dealt out in blocks (exact_blocks); both are exact.

    Memories are counted by project and set of scopes first, so queries meet those counts and not the memories.
    """
    counts = memories.groupBy("project_id", F.array_sort("scope_keys").alias("scope_keys")).agg(F.count("*").alias("_n"))
    n = queries.join(counts, "project_id").where(scope_overlap(F.col("scope_keys"), F.col("scopes"))).groupBy("query_id").agg(F.sum("_n").alias("n"))
    out = queries.select("query_id").join(n, "query_id", "left").withColumn("n", F.least(F.coalesce("n", F.lit(0)), F.lit(limit + 1)))
    return out.withColumn("path", F.when(F.col("n") <= limit, "exact").otherwise("exact_blocks"))


def leg_union(**legs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select("query_id", "id", "pos", F.lit(name).alias("leg")) for name, df in legs.items()])


def leg_rank(legs: DataFrame) -> DataFrame:
    """1, 2, ... in each leg; a repeated id counts once, at its best place."""
    once = legs.groupBy("query_id", "leg", "id").agg(F.min("pos").alias("pos"))
    return once.withColumn("leg_rank", F.row_number().over(Window.partitionBy("query_id", "leg").orderBy("pos", "id")))


def rrf_fuse(legs: DataFrame, k: int = RRF_K) -> DataFrame:
    """score: the sum of 1 / (k + rank) over legs; pos by rounded score, then id."""
    fused = leg_rank(legs).groupBy("query_id", "id").agg(F.sum(1 / (k + F.col("leg_rank"))).alias("score"))
    return fused.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(quantize(F.col("score")).desc(), "id")))


def rerank_head(results: DataFrame, order: Callable[[pd.DataFrame], list], depth: int = RERANK_DEPTH, limit: int = LIMIT) -> DataFrame:
    """Puts the first `depth` results of each query in the order of ids that `order` gives; the rest follow."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        head, rest = part[:depth], part[depth:]
        ids = list(order(head))
        if sorted(ids) != sorted(head["id"]):
            raise ValueError("a reranker must return a permutation")
        out = pd.concat([head.set_index("id").loc[ids].reset_index(), rest])[:limit]
        return out.assign(pos=range(1, len(out) + 1))[["query_id", "id", "score", "pos"]]

    few = results.where(F.col("pos") <= max(depth, limit))  # nothing beyond can be returned
    return few.groupBy("query_id").applyInPandas(run, "query_id long, id long, score double, pos int")


def search_legs(queries: DataFrame, memories: DataFrame, embeddings: DataFrame, depth: int = DEPTH, dense: DataFrame | None = None, text: Callable[..., DataFrame] = text_topk) -> DataFrame:
    """The legs of queries (query_id, vec, text, and the filters project_id, model_id, scopes) over memories that are
    live and trusted: query_id, id, pos, leg, status. The entity leg is a stub, one row without an id per query.
    `dense` is a dense leg made elsewhere (vector_index.dense_leg) in place of the exact one, `text` the text search."""
    live = exclude_quarantine(live_head(memories))
    legs = leg_union(dense=dense_topk(queries, with_vectors(live, embeddings), depth) if dense is None else dense, lexical=text(queries, live, depth))
    stub = queries.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("pos"), F.lit("entity").alias("leg"), F.lit("stub").alias("status"))
    return legs.withColumn("status", F.when(F.col("leg") == "dense", "exact").otherwise("text")).unionByName(stub)


def hybrid_retrieve(
    queries: DataFrame, memories: DataFrame, embeddings: DataFrame, limit: int = LIMIT, depth: int = DEPTH,
    order: Callable[[pd.DataFrame], list] | None = None, rerank_depth: int = RERANK_DEPTH, dense: DataFrame | None = None, text: Callable[..., DataFrame] = text_topk,
) -> DataFrame:
    """query_id, id, kind, content, score, pos: the legs of search_legs, fused, and reranked by `order` where it is given."""
    fused = rrf_fuse(search_legs(queries, memories, embeddings, depth, dense, text).where("id IS NOT NULL"))
    content = memories.select("id", "kind", "content")
    if order is None:
        return fused.where(F.col("pos") <= limit).join(content, "id").select("query_id", "id", "kind", "content", "score", "pos")
    head = fused.where(F.col("pos") <= max(limit, rerank_depth)).join(content, "id")
    return rerank_head(head, order, rerank_depth, limit).join(content, "id").select("query_id", "id", "kind", "content", "score", "pos")


def distinct_contents(candidates: DataFrame, dim: int | None = None) -> DataFrame:
    """Texts to embed, once each; with dim, vectors of another size are an error."""
    rows = candidates if dim is None else candidates.where(F.assert_true(F.size("vec") == dim).isNull())
    return rows.select("content").distinct()


