"""Exact and near merges of one pass as one chain of versions.

Candidates of a context (equal project, kind and entities) are folded in order: one with the fingerprint of a live
memory merges into it and leaves its content; one that is near enough to the nearest of the newest memories replaces
that memory's content, fingerprint and vector; any other becomes a memory. What a merge changes, later candidates see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import BUCKET_CAP, GRAY, MERGE, near_merge_reason

CONTEXT = ["project_id", "context_hash"]


class Context:
    """Live memories of one context: all fingerprints that matter, and the newest `cap` vectors in a ring."""

    def __init__(self, cap: int):
        self.cap, self.by_hash, self.ring, self.next = cap, {}, [], 0
        self.table: np.ndarray | None = None

    def add(self, memory: dict, vec: np.ndarray | None) -> None:
        """A memory, and its place among the newest where it has a vector."""
        if memory["hash"] not in self.by_hash or memory["id"] < self.by_hash[memory["hash"]]["id"]:
            self.by_hash[memory["hash"]] = memory
        if vec is None:
            return
        if self.table is None:
            self.table = np.zeros((self.cap, len(vec)))
        if len(self.ring) < self.cap:
            self.ring.append(memory)
            self.table[len(self.ring) - 1] = vec
        else:
            self.ring[self.next], self.table[self.next] = memory, vec
            self.next = (self.next + 1) % self.cap

    def nearest(self, vec: np.ndarray) -> tuple[int, float] | None:
        """Place in the ring and cosine of the nearest memory, ties by id."""
        if not self.ring:
            return None
        near = (self.table[: len(self.ring)] @ vec).round(9)
        best = min(np.flatnonzero(near == near.max()).tolist(), key=lambda k: self.ring[k]["id"])
        return best, float(self.table[best] @ vec)

    def fold(self, row_id, content_hash: str, vec: np.ndarray, merge: float, gray: float) -> tuple:
        """outcome, memory, gray, cosine, version, the row whose content is replaced or kept, the row whose content is live."""
        exact = self.by_hash.get(content_hash)
        if exact is not None:
            exact["version"] += 1
            return "exact_merged", exact["id"], False, None, exact["version"], exact["row"], exact["row"]
        near = self.nearest(vec)
        if near is not None and near[1] >= merge:
            k, cosine = near
            memory = self.ring[k]
            old = memory["row"]
            if self.by_hash.get(memory["hash"]) is memory:
                del self.by_hash[memory["hash"]]
            memory.update(version=memory["version"] + 1, hash=content_hash, row=row_id)
            self.by_hash[content_hash], self.table[k] = memory, vec
            return "near_merged", memory["id"], False, cosine, memory["version"], old, row_id
        self.add({"id": row_id, "version": 1, "hash": content_hash, "row": row_id}, vec)
        return "inserted", row_id, near is not None and near[1] >= gray, None if near is None else near[1], 1, None, row_id


def fold_candidates(candidates: DataFrame, memories: DataFrame | None = None, *, merge: float = MERGE, gray: float = GRAY, cap: int = BUCKET_CAP) -> DataFrame:
    """One row per candidate (project_id, context_hash, content_hash, arrival, id, vec of length 1): outcome (inserted,
    exact_merged, near_merged), memory_id, gray, cosine, version of the memory after it, replaced_id (the row whose
    content the merge retires) and live_id (the row whose content is live then).

    `memories` (project_id, context_hash, content_hash, id, version, created_at, vec) are the live ones; of those only
    the contexts of candidates are read, and of each context the newest `cap` and those with a candidate's
    fingerprint. The order within a context is the meaning of the operator: a context is one sorted stream of rows,
    and the state of a stream is `cap` vectors and the fingerprints of the pass.
    """
    id_type = candidates.schema["id"].dataType.simpleString()
    key = [*CONTEXT, "content_hash", "id", "vec"]
    rows = candidates.select(*key, "arrival", F.lit(1).alias("version"), F.lit(1).alias("_kind"))
    order = ["_kind", "arrival", "id"]
    if memories is not None:
        touched = memories.join(candidates.select(*CONTEXT).distinct(), CONTEXT, "left_semi")
        nth = F.row_number().over(Window.partitionBy(*CONTEXT).orderBy(F.desc("created_at"), F.desc("id")))
        newest = touched.withColumn("_nth", nth).where(F.col("_nth") <= cap)
        same = touched.join(candidates.select(*CONTEXT, "content_hash").distinct(), [*CONTEXT, "content_hash"], "left_semi").join(newest.select(*CONTEXT, "id"), [*CONTEXT, "id"], "left_anti")
        held = newest.select(*key, "_nth", "version").unionByName(same.select(*key, F.lit(None).cast("int").alias("_nth"), "version"))
        rows = rows.withColumn("_nth", F.lit(None).cast("int")).unionByName(held.withColumns({"_kind": F.lit(0), "arrival": F.lit(None).cast(candidates.schema["arrival"].dataType), "version": F.col("version").cast("int")}))
        order = ["_kind", F.desc_nulls_last("_nth"), "arrival", "id"]
        rows = rows.withColumn("_newest", F.col("_nth").isNotNull())
    else:
        rows = rows.withColumn("_newest", F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, context = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.project_id, r.context_hash) != at:
                    at, context = (r.project_id, r.context_hash), Context(cap)
                vec = None if r.vec is None else np.asarray(r.vec, dtype=np.float64)
                if r.stored:
                    context.add({"id": r.id, "version": r.version, "hash": r.content_hash, "row": r.id}, vec if r.newest else None)
                else:
                    out.append((*at, r.id, *context.fold(r.id, r.content_hash, vec, merge, gray)))
            found = pd.DataFrame(out, columns=["project_id", "context_hash", "id", "outcome", "memory_id", "gray", "cosine", "version", "replaced_id", "live_id"])
            if id_type in ("bigint", "int"):
                found = found.astype({"replaced_id": "Int64"})
            yield found

    ordered = rows.repartition(*CONTEXT).sortWithinPartitions(*CONTEXT, *order)
    ordered = ordered.select(*CONTEXT, "content_hash", "id", "vec", "version", (F.col("_kind") == 0).alias("stored"), F.col("_newest").alias("newest"))
    return ordered.mapInPandas(run, f"project_id string, context_hash string, id {id_type}, outcome string, memory_id {id_type}, gray boolean, cosine double, version int, replaced_id {id_type}, live_id {id_type}")


def folded_memories(folded: DataFrame, contents: DataFrame) -> DataFrame:
    """The memories that a fold inserted or merged into, as they are after it: project_id, memory_id, version, content,
    content_hash, context_hash, vec, inserted (new in this pass), rewritten (its content and vector changed).

    `contents` (id, content, content_hash, vec) holds candidates and stored memories."""
    last = folded.groupBy(*CONTEXT, "memory_id").agg(
        F.max("version").alias("version"), F.max_by("live_id", "version").alias("id"),
        F.max(F.col("outcome") == "inserted").alias("inserted"), F.max(F.col("outcome") != "exact_merged").alias("rewritten"),
    )
    return last.join(contents.select("id", "content", "content_hash", "vec"), "id").drop("id")


def folded_versions(folded: DataFrame, contents: DataFrame) -> DataFrame:
    """A version row (project_id, memory_id, version, content, changed_by, reason) for each merge: what was live before.

    `contents` (id, content, content_hash, and agent_id and source_seq of candidates) as in folded_memories."""
    merged = folded.where("outcome <> 'inserted'").join(contents.select("id", F.col("content_hash").alias("_new"), "agent_id", "source_seq"), "id")
    old = contents.select(F.col("id").alias("replaced_id"), "content", F.col("content_hash").alias("_old"))
    exact = F.concat(F.lit("merged duplicate content from event seq "), F.col("source_seq").cast("string"))
    reason = F.when(F.col("outcome") == "exact_merged", exact).otherwise(near_merge_reason(F.col("cosine"), F.col("source_seq"), F.col("_old"), F.col("_new")))
    return merged.join(old, "replaced_id").select("project_id", "memory_id", (F.col("version") - 1).alias("version"), "content", F.col("agent_id").alias("changed_by"), reason.alias("reason"))
