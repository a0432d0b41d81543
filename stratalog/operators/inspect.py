"""Reading and closing rows: pages, lookups, soft deletes, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieve import live_head

PAGE, MOST = 50, 200


def memory_run(memories: DataFrame, events: DataFrame) -> DataFrame:
    """Memories with the run of their source event, where they have one."""
    return memories.join(events.select(F.col("id").alias("source_event_id"), "run_id", F.col("seq").alias("event_seq")), "source_event_id", "left")


def browse_filters(memories: DataFrame, **filters) -> DataFrame:
    """Equality filters by column; None is no filter."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == F.lit(kv[1])), [kv for kv in filters.items() if kv[1] is not None], memories)


def keyset_page(rows: DataFrame, limit: int = PAGE, cursor: tuple | None = None) -> DataFrame:
    """One page by (created_at, id), newest first, after the cursor; has_more on every row."""
    limit = min(limit, MOST)
    if cursor:
        at, row_id = F.lit(cursor[0]).cast(rows.schema["created_at"].dataType), F.lit(cursor[1])
        rows = rows.where((F.col("created_at") < at) | (F.col("created_at") == at) & (F.col("id") < row_id))
    page = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)
    nth = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))
    return page.withColumn("nth", nth).withColumn("has_more", F.max("nth").over(Window.partitionBy()) > limit).where(F.col("nth") <= limit)


def browse_page(memories: DataFrame, limit: int = PAGE, cursor: tuple | None = None, **filters) -> DataFrame:
    return keyset_page(browse_filters(live_head(memories), **filters), limit, cursor)


def trace_page(pack_logs: DataFrame, run_id: str, limit: int = PAGE, cursor: tuple | None = None) -> DataFrame:
    return keyset_page(pack_logs.where(F.col("run_id") == run_id), limit, cursor)


def version_list(versions: DataFrame, memory_ids: DataFrame) -> DataFrame:
    return versions.join(memory_ids, "memory_id", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("memory_id").orderBy("version")))


def get_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "id", "left_semi")


def exists_check(ids: DataFrame, rows: DataFrame) -> DataFrame:
    return ids.join(rows.select("id", F.lit(True).alias("found")).dropDuplicates(["id"]), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def soft_delete(memories: DataFrame, ids: DataFrame, now: Column, actor: str) -> tuple[DataFrame, DataFrame]:
    """Memories with the validity of the live ones among `ids` closed, and an audit row for each that changed."""
    asked = ids.select("id", F.lit(True).alias("_asked")).dropDuplicates(["id"])
    marked = memories.join(asked, "id", "left").withColumn("_hit", F.col("_asked").isNotNull() & F.col("valid_to").isNull() & F.col("superseded_by").isNull())
    out = marked.withColumn("valid_to", F.when(F.col("_hit"), now.cast(memories.schema["valid_to"].dataType)).otherwise(F.col("valid_to"))).drop("_asked", "_hit")
    audit = marked.where("_hit").select("project_id", F.lit(actor).alias("actor"), F.lit("memory.delete").alias("action"), F.col("id").alias("target_id"))
    return out, audit


def insert_memories(candidates: DataFrame) -> DataFrame:
    """Fresh memories with their default columns."""
    return candidates.withColumns({
        "version": F.lit(1), "trust_tier": F.lit("normal"), "review_status": F.lit("auto_approved"), "scope_keys": F.array().cast("array<string>"),
        "valid_to": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("string"),
    })


def create_runs(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"last_seq": F.lit(0).cast("long"), "covered_seq": F.lit(0).cast("long"), "extraction_mode": F.lit("realtime")})


def memory_scopes(tags: DataFrame) -> DataFrame:
    """scope_keys of each memory from its tags (memory_id, scope_type, scope_id), in order of type and id."""
    found = F.array_sort(F.collect_set(F.struct("scope_type", "scope_id")))
    return tags.groupBy("memory_id").agg(F.transform(found, lambda t: F.concat(t["scope_type"], F.lit(":"), t["scope_id"])).alias("scope_keys"))


def upsert_embeddings(new: DataFrame, current: DataFrame) -> DataFrame:
    """The vector that arrived last per project, memory and model."""
    keys = ["project_id", "memory_id", "model_id"]
    rows = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return rows.groupBy(*keys).agg(F.max_by("vec", F.struct("_new", "arrival")).alias("vec"))


def write_tenant_partitions(df: DataFrame, path: str) -> None:
    """Writes by project; only the projects in `df` are replaced."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("project_id").parquet(path)


def drop_tenant(df: DataFrame, project_id: str) -> DataFrame:
    """Rows of all other projects, and those without one."""
    return df.where(~F.col("project_id").eqNullSafe(project_id))
