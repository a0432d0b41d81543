"""Deduplication of memories: by fingerprint, and by vector similarity within a bucket."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.text import content_fingerprint, context_fingerprint, fingerprint_prefix, normalize_content

MERGE, GRAY, BUCKET_CAP = 0.92, 0.85, 200
#: Rows of a bucket that stand in one block of a similarity join.
BLOCK = 1024
#: Rows of a bucket that are all compared, and the chance with which a pair of a larger one is found at least.
LARGE, RECALL = 20_000, 0.97


def fingerprints(candidates: DataFrame) -> DataFrame:
    kind, names, content = F.col("kind"), F.col("entity_names"), F.col("content")
    return candidates.withColumns({"content_norm": normalize_content(content), "content_hash": content_fingerprint(kind, names, content), "context_hash": context_fingerprint(kind, names)})


def exact_dup_probe(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """The live memory of least id with each candidate's fingerprint, or null. Closed memories are passed over, where
    the columns that tell are there."""
    closed = [F.col(c).isNotNull() for c in ("superseded_by", "valid_to") if c in memories.columns]
    live = memories.where(~reduce(or_, closed)) if closed else memories
    first = live.groupBy("project_id", "content_hash").agg(F.min("id").alias("duplicate_of"))
    return candidates.join(first, ["project_id", "content_hash"], "left")


def exact_dedup(candidates: DataFrame, memories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Memories (the first of each fingerprint, with its version) and versions (one row per merge of a later one).

    `memories` (project_id, content_hash, id, version, content) are the live ones of earlier passes: a candidate with
    the fingerprint of one merges into that of least id. `inserted` tells new memories; stored ones without a
    candidate are not in the result. Contents are aggregated; only ids and seqs of copies come together in a window.
    """
    key = ["project_id", "content_hash"]
    heads = candidates.groupBy(*key).agg(F.min_by(F.struct("id", "content"), "arrival").alias("_first"), F.count("*").alias("_n"))
    if memories is None:
        heads = heads.withColumn("_held", F.lit(None).cast(f"struct<id:{candidates.schema['id'].dataType.simpleString()},version:int,content:string>"))
    else:
        held = memories.groupBy(*key).agg(F.min_by(F.struct("id", F.col("version").cast("int").alias("version"), "content"), "id").alias("_held"))
        heads = heads.join(held, key, "left")
    heads = heads.select(
        *key, F.coalesce("_held.id", "_first.id").alias("memory_id"), F.coalesce("_held.version", F.lit(0)).alias("_from"),
        F.coalesce("_held.content", "_first.content").alias("content"), F.col("_held").isNull().alias("inserted"), "_n",
    )
    found = heads.select(*key, "memory_id", (F.col("_from") + F.col("_n")).cast("int").alias("version"), "content", "inserted")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("arrival"))
    reason = F.concat(F.lit("merged duplicate content from event seq "), F.col("source_seq").cast("string"))
    rows = candidates.select(*key, "agent_id", "source_seq", "arrival").withColumn("_nth", nth).join(heads.select(*key, "memory_id", "_from", "content"), key)
    rows = rows.withColumn("version", (F.col("_from") + F.col("_nth") - 1).cast("int")).where("version > 0")
    return found, rows.select("project_id", "memory_id", "version", "content", F.col("agent_id").alias("changed_by"), reason.alias("reason"))


def nearest_in_bucket(candidates: DataFrame, memories: DataFrame, cap: int | None = BUCKET_CAP, block: int = BLOCK) -> DataFrame:
    """Per candidate (cand_id, bucket, vec of length 1) the nearest of the newest `cap` memories (id, bucket, vec,
    created_at), or of all with None, of its bucket, and of its project_id and model_id where both sides have them, with
    the full size.

    Both sides of a bucket are dealt into blocks, each pair of blocks is one product, and of each only the nearest memory
    of a candidate is kept: a bucket of any size is many tasks.
    """
    keys = ["bucket", *[c for c in ("project_id", "model_id") if c in candidates.columns and c in memories.columns]]
    types = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in keys)
    sizes = memories.groupBy(*keys).agg(F.count("*").alias("bucket_size"))
    held = memories
    if cap is not None:
        # Spark keeps the newest of each bucket in every task before it brings them together.
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created_at"), "id"))
        held = memories.withColumn("_nth", nth).where(F.col("_nth") <= cap)

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_n"))
        rows = rows.join(blocks, keys).withColumn("_of", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
        # Vectors one after the other, so that Python gets one array of numbers.
        packed = rows.groupBy(*keys, "_of").agg(F.collect_list(F.struct("id", "vec")).alias("x"))
        return packed.select(*keys, F.col("_of").alias(f"{name}_block"), F.col("x.id").alias(f"{name}_ids"), F.flatten("x.vec").alias(f"{name}_vecs"))

    vec = F.col("vec").cast("array<double>").alias("vec")
    left = dealt(candidates.select(F.col("cand_id").alias("id"), *keys, vec), "cand")
    right = dealt(held.select("id", *keys, vec), "held")
    # A row is two blocks, and a group holds one pair of them, so Python has no more than that at a time.
    pairs = left.join(right, keys).groupBy(*keys, "cand_block", "held_block")

    def search(pair: pd.DataFrame) -> pd.DataFrame:
        row = pair.iloc[0]
        ids, order = row["cand_ids"], np.argsort(row["held_ids"])  # the first of equally near ones counts
        held_ids, table = row["held_ids"][order], row["held_vecs"].reshape(len(order), -1)[order]
        distance = 1 - row["cand_vecs"].reshape(len(ids), -1) @ table.T
        best = distance.round(9).argmin(axis=1)
        return pd.DataFrame({c: row[c] for c in keys} | {"cand_id": ids, "id": held_ids[best], "distance": distance[np.arange(len(ids)), best]})

    found = pairs.applyInPandas(search, f"{types}, cand_id long, id long, distance double")
    nearest = found.groupBy(*keys, "cand_id").agg(F.min_by(F.struct("id", "distance"), F.struct(F.round("distance", 9), "id")).alias("x"))
    return nearest.join(sizes, keys).select("cand_id", "x.id", "bucket_size", "x.distance")


def projections(least: float, rows: int, block: int, recall: float) -> tuple[int, int]:
    """Bits of a code and number of tables, so that a bucket of this size falls into groups of about a block and a pair of
    cosine `least` agrees in one of the tables with a chance of `recall`."""
    same = 1 - np.arccos(least) / np.pi
    bits = int(min(20, max(1, np.ceil(np.log2(max(2.0, rows / block))))))
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - same**bits)))


def projection_codes(rows: DataFrame, bits: int, tables: int, seed: int = 11) -> DataFrame:
    """Adds codes: in each table the signs of `bits` random projections as one number."""

    def run(vecs: pd.Series) -> pd.Series:
        table = np.stack(vecs.to_numpy()).astype(np.float64)
        planes = np.random.default_rng(seed).normal(size=(table.shape[1], tables * bits))
        signs = (table @ planes >= 0).reshape(len(table), tables, bits)
        return pd.Series(list((signs << np.arange(bits)).sum(axis=2).astype(np.int32)))

    return rows.withColumn("codes", F.pandas_udf(run, "array<int>")("vec"))


def _group_pairs(rows: DataFrame, keys: list[str], least: float, block: int) -> DataFrame:
    """bucket, a, b, cosine of the pairs within groups of equal keys (bucket first). Where rows have codes, a pair counts
    in the first table in which its codes agree, and the last key is that table's number.

    A group is dealt into packed blocks, and each pair of blocks is one product; a group of any size is many tasks.
    """
    coded = "codes" in rows.columns
    own = rows.withColumn("codes", F.array().cast("array<int>")) if not coded else rows
    sizes = own.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where(F.col("blocks") > 0)
    dealt = own.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    packed = dealt.groupBy(*keys, "blocks", "own").agg(F.collect_list(F.struct("id", "vec", "codes")).alias("rows"))
    packed = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    packed = packed.select(*keys, F.least("own", "with").alias("left"), F.greatest("own", "with").alias("right"), "own", "rows")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part["left"].iat[0], part["right"].iat[0]
        sides = [part[part["own"] == k]["rows"].tolist() for k in (left, right)]
        none = pd.DataFrame({"bucket": [], "a": [], "b": [], "cosine": []})
        if not sides[0] or not sides[1]:
            return none
        first, second = (sorted(x[0], key=lambda r: r["id"]) for x in sides)
        ids = [np.array([r["id"] for r in x]) for x in (first, second)]
        cosine = np.stack([r["vec"] for r in first]).astype(np.float64) @ np.stack([r["vec"] for r in second]).astype(np.float64).T
        i, j = np.nonzero(cosine >= least)
        keep = ids[0][i] < ids[1][j] if left == right else np.ones(len(i), dtype=bool)
        i, j = i[keep], j[keep]
        if coded and len(i):
            codes = [np.stack([r["codes"] for r in x]) for x in (first, second)]
            earliest = (codes[0][i] == codes[1][j]).argmax(axis=1) == part[keys[-1]].iat[0]
            i, j = i[earliest], j[earliest]
        a, b = ids[0][i], ids[1][j]
        return pd.DataFrame({"bucket": part["bucket"].iat[0], "a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": cosine[i, j]})

    return packed.groupBy(*keys, "left", "right").applyInPandas(compare, "bucket long, a long, b long, cosine double")


def dup_pairs(rows: DataFrame, least: float = GRAY, merge: float = MERGE, block: int = BLOCK, *, large: int = LARGE, recall: float = RECALL) -> DataFrame:
    """Pairs a < b of a bucket (id, bucket, vec of length 1) with similarity of `least` or more, and their band.

    Buckets of at most `large` rows are compared in full. In a larger one only rows are compared whose random
    projections agree in one of several tables, exactly; their number of tables is chosen so that a pair of just
    `least` is found with a chance of `recall`, a nearer one with a greater one. A row is exchanged once for each table.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    sized = rows.select("bucket", "id", "vec").join(sizes, "bucket")
    pairs = _group_pairs(sized.where(F.col("_n") <= large).drop("_n"), ["bucket"], least, block)
    if most > large:
        bits, tables = projections(least, most, block, recall)
        coded = projection_codes(sized.where(F.col("_n") > large).drop("_n"), bits, tables)
        coded = coded.select("*", F.posexplode("codes").alias("table", "code"))
        pairs = pairs.unionByName(_group_pairs(coded, ["bucket", "code", "table"], least, block))
    return pairs.withColumn("band", F.when(F.col("cosine") >= merge, "merge").otherwise("gray"))


FOLDED = "bucket long, id long, outcome string, memory_id long, gray boolean, cosine double, version int, replaced_id long"


def near_dedup(candidates: DataFrame, merge: float = MERGE, gray: float = GRAY, cap: int = BUCKET_CAP, memories: DataFrame | None = None) -> DataFrame:
    """Folds candidates (bucket, arrival, id, vec) in order of arrival, bucket by bucket.

    The nearest of the newest `cap` live memories decides: from `merge` on the candidate replaces its content and
    vector (outcome near_merged; replaced_id is the candidate or memory whose content goes), from `gray` on it is
    inserted and flagged, else inserted. `memories` (bucket, arrival, id, vec, version) are those of earlier passes,
    which come before all candidates. The order within a bucket is the meaning of the operator, so a bucket is one
    stream of rows: they arrive sorted in batches, and no more than `cap` memories are held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, used, oldest = None, 0, 0
        ids, last, versions = np.zeros(cap, dtype=np.int64), np.zeros(cap, dtype=np.int64), np.zeros(cap, dtype=np.int64)
        table = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                vec = np.asarray(row.vec, dtype=np.float64)
                if row.bucket != bucket:
                    bucket, used, oldest = row.bucket, 0, 0
                if table is None or table.shape[1] != len(vec):
                    table = np.zeros((cap, len(vec)))
                outcome, memory, flagged, cosine, version, replaced = "inserted", row.id, False, None, row.version, None
                if used and not row.stored:
                    near = (table[:used] @ vec).round(9)
                    best = np.flatnonzero(near == near.max())
                    k = best[np.argmin(ids[best])]
                    cosine = float(table[k] @ vec)
                    if cosine >= merge:
                        outcome, memory, replaced = "near_merged", int(ids[k]), int(last[k])
                        versions[k] += 1
                        version = int(versions[k])
                        table[k], last[k] = vec, row.id
                    else:
                        flagged = cosine >= gray
                if outcome == "inserted":
                    k = used if used < cap else oldest
                    used, oldest = min(used + 1, cap), (oldest + 1) % cap if used == cap else 0
                    ids[k], last[k], versions[k], table[k] = row.id, row.id, version, vec
                if not row.stored:
                    out.append((bucket, row.id, outcome, memory, flagged, cosine, version, replaced))
            found = pd.DataFrame(out, columns=["bucket", "id", "outcome", "memory_id", "gray", "cosine", "version", "replaced_id"])
            yield found.astype({"replaced_id": "Int64"})

    rows = candidates.select("bucket", "arrival", "id", "vec", F.lit(1).alias("version"), F.lit(False).alias("stored"))
    if memories is not None:
        rows = rows.unionByName(memories.select("bucket", "arrival", "id", "vec", F.col("version").cast("int").alias("version"), F.lit(True).alias("stored")))
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", F.desc("stored"), "arrival", "id")
    return ordered.mapInPandas(fold, FOLDED)


def near_merged(folded: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a fold does to memories: those that it inserted or changed (memory_id, version, content, content_hash, vec),
    and a version row for each content that was replaced, with the reason.

    `contents` (id, content, content_hash, vec, agent_id, source_seq) holds candidates and stored memories.
    """
    last = folded.groupBy("bucket", "memory_id").agg(F.max("version").alias("version"), F.max_by("id", "version").alias("id"))
    memories = last.join(contents.select("id", "content", "content_hash", "vec"), "id").select("bucket", "memory_id", "version", "content", "content_hash", "vec")
    merged = folded.where("outcome = 'near_merged'").join(contents.select("id", F.col("content_hash").alias("new_hash"), "agent_id", "source_seq"), "id")
    old = contents.select(F.col("id").alias("replaced_id"), "content", F.col("content_hash").alias("old_hash"))
    reason = near_merge_reason(F.col("cosine"), F.col("source_seq"), F.col("old_hash"), F.col("new_hash"))
    versions = merged.join(old, "replaced_id").select("bucket", "memory_id", (F.col("version") - 1).alias("version"), "content", F.col("agent_id").alias("changed_by"), reason.alias("reason"))
    return memories, versions


def dedup_funnel(outcomes: DataFrame) -> DataFrame:
    rows = outcomes.select("outcome").unionByName(outcomes.where("gray").select(F.lit("gray_zone").alias("outcome")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def near_merge_reason(cosine, seq, old_hash, new_hash):
    return F.format_string("near-duplicate (cosine %.4f) superseded by event seq %d; %s -> %s", cosine, seq, fingerprint_prefix(old_hash), fingerprint_prefix(new_hash))
