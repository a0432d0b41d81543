"""Entities and claims: registry, supersession chains, field merges."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBJECT = ["project_id", "entity", "predicate"]


def register_entities(mentions: DataFrame, claims: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """project_id, name, type, aliases, arrival: the first writer of a name decides; subjects of claims that nobody
    mentions have the type unknown; no aliases are an empty list."""
    told = mentions.select("project_id", "name", "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "arrival", F.lit(0).alias("_by"))
    subject = claims.select("project_id", F.col("entity").alias("name"), F.lit("unknown").alias("type"), F.array().cast("array<string>").alias("aliases"), "arrival", F.lit(1).alias("_by"))
    rows = told.unionByName(subject)
    first = rows.groupBy("project_id", "name").agg(F.min_by(F.struct("type", "aliases", "arrival"), F.struct("_by", "arrival")).alias("x")).select("project_id", "name", "x.*")
    if registry is None:
        return first
    return registry.select("project_id", "name", "type", "aliases", "arrival").unionByName(first.join(registry, ["project_id", "name"], "left_anti"))


def active_claims(claims: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Active claims of some entities with the run and seq of their event, where it is known."""
    own = claims.where("superseded_by IS NULL").join(entities.select("project_id", "entity").distinct(), ["project_id", "entity"], "left_semi")
    source = events.select(F.col("id").alias("source_event_id"), F.col("run_id").alias("source_run"), F.col("seq").alias("event_seq"))
    return own.join(source, "source_event_id", "left")


def _with_stored(claims: DataFrame, stored: DataFrame | None) -> DataFrame:
    """New claims after the stored active ones of their subjects; _new tells them apart."""
    rows = claims.withColumn("_new", F.lit(1))
    if stored is None:
        return rows
    columns = [c for c in claims.columns if c in stored.columns]
    held = stored.join(claims.select(*SUBJECT).distinct(), SUBJECT, "left_semi").select(*columns, F.lit(0).alias("_new"))
    return rows.unionByName(held, allowMissingColumns=True)


def resolve_claims_lww(claims: DataFrame, policy: str = "last-write-wins", stored: DataFrame | None = None) -> DataFrame:
    """superseded_by: the next claim of the subject in arrival order; the last one is active. The reason names both.

    `stored` holds the active claims of earlier passes; those of the subjects at hand come before all new ones, and
    are in the result with what closed them.
    """
    w = Window.partitionBy(*SUBJECT).orderBy("_new", "arrival", "id")
    nxt = F.lead(F.struct("id", "run_id", "source_seq")).over(w)
    out = _with_stored(claims, stored).withColumn("_next", nxt).withColumn("superseded_by", F.col("_next.id"))
    line = F.format_string(
        policy + ": claim %s (run %s seq %s) supersedes claim %s (run %s seq %s)", F.col("_next.id").cast("string"), F.col("_next.run_id"), F.col("_next.source_seq").cast("string"),
        F.col("id").cast("string"), F.col("run_id"), F.coalesce("source_seq", F.lit(0)).cast("string"),
    )
    return out.withColumn("resolution_reason", F.when(F.col("_next").isNotNull(), line)).drop("_next", "_new")


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def _fields(value: Column) -> Column:
    """The fields of an object as a map from key to JSON text."""
    return F.transform_values(F.from_json(value, "map<string,variant>"), lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))


def _object(fields: Column) -> Column:
    """A map from key to JSON text as an object, by key."""
    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _segments(claims: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Claims by number in their subject and segment: a value that is no object opens a segment and stands alone."""
    w = Window.partitionBy(*SUBJECT).orderBy("_new", "arrival", "id")
    obj = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    rows = _with_stored(claims, stored).withColumn("_obj", obj)
    return rows.withColumns({"_nth": F.row_number().over(w), "_part": F.sum((~F.col("_obj")).cast("int")).over(w)})


def resolve_claims_merge(claims: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The merged value of each subject: fields of later objects win; a value that is no object replaces all before it,
    and the next object starts afresh. `stored` as in resolve_claims_lww.

    One row per subject with value and reason of its last claim.
    """
    rows = _segments(claims, stored).withColumn("_last", F.max("_part").over(Window.partitionBy(*SUBJECT))).where(F.col("_part") == F.col("_last"))
    last = rows.groupBy(*SUBJECT).agg(F.max_by(F.struct("_obj", "value"), "_nth").alias("x"), F.sum(F.col("_obj").cast("int")).alias("objects"))
    fields = rows.where("_obj").select(*SUBJECT, "_nth", F.explode(_fields(F.col("value"))).alias("key", "field"))
    fields = fields.groupBy(*SUBJECT, "key").agg(F.max_by("field", "_nth").alias("field"))
    merged = fields.groupBy(*SUBJECT).agg(_object(F.map_from_entries(F.collect_list(F.struct("key", "field")))).alias("merged"))
    out = last.join(merged, SUBJECT, "left")
    return out.select(
        *SUBJECT, F.when(F.col("x._obj"), F.coalesce("merged", F.lit("{}"))).otherwise(F.col("x.value")).alias("value"),
        F.when(F.col("x._obj") & (F.col("objects") > 1), "field-merge").otherwise("last-write-wins").alias("reason"),
    )


def merge_history(claims: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per claim, stored ones too, the value of its subject once it is merged, the reason, and superseded_by, the next claim.

    The claims of a subject are one sorted stream that holds the fields of the current segment, so the work grows with
    the claims and the text of their values.
    """
    nxt = F.lead("id").over(Window.partitionBy(*SUBJECT).orderBy("_nth"))
    entries = F.transform(F.map_entries(_fields(F.col("value"))), lambda e: F.struct(e["key"].alias("key"), F.concat(_quoted(e["key"]), F.lit(":"), e["value"]).alias("text")))
    rows = _segments(claims, stored).withColumn("superseded_by", nxt).drop("_new")
    rows = rows.withColumns({"_subject": F.struct(*SUBJECT), "_entries": F.when(F.col("_obj"), entries), "reason": F.lit("")})
    kept = [c for c in rows.columns if c not in ("_obj", "_nth", "_part", "_subject", "_entries")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fields, keys, before = None, {}, [], 0
        for batch in batches:
            value, reason = batch.column("value").to_pylist(), []
            for i, (subject, part, entries) in enumerate(zip(batch.column("_subject").to_pylist(), batch.column("_part").to_pylist(), batch.column("_entries").to_pylist(), strict=True)):
                if (subject, part) != at:
                    at, fields, keys, before = (subject, part), {}, [], 0
                if entries is None:
                    reason.append("last-write-wins")
                    continue
                for e in entries:
                    if e["key"] not in fields:
                        insort(keys, e["key"])
                    fields[e["key"]] = e["text"]
                before += 1
                value[i] = "{" + ",".join([fields[k] for k in keys]) + "}"
                reason.append("field-merge" if before > 1 else "last-write-wins")
            made = {"value": pa.array(value, batch.schema.field("value").type), "reason": pa.array(reason, batch.schema.field("reason").type)}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in kept], names=kept)

    ordered = rows.repartition(*SUBJECT).sortWithinPartitions(*SUBJECT, "_nth")
    return ordered.mapInArrow(merge, rows.select(*kept).schema)


def supersede_claims(claims: DataFrame, closed: DataFrame) -> DataFrame:
    """Closes claims by id (claim_id, by); those closed before stay as they are."""
    by = closed.select(F.col("claim_id").alias("id"), F.col("by").alias("_by"))
    return claims.join(by, "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "_by")).drop("_by")


def link_claims(claims: DataFrame, memories: DataFrame) -> DataFrame:
    """memory_id: the first memory from the claim's event, or null."""
    first = memories.groupBy("run_id", "source_seq").agg(F.min_by("id", "arrival").alias("memory_id"))
    return claims.join(first, ["run_id", "source_seq"], "left")


def claims_union(extracted: DataFrame, facts: DataFrame) -> DataFrame:
    """Extracted claims and working facts as claims, the extracted one first where both come from one event."""
    columns = ["project_id", "run_id", "entity", "predicate", "value", "source_seq"]
    return extracted.select(*columns, F.lit(0).alias("source_ord")).unionByName(facts.select(*columns, F.lit(1).alias("source_ord")))


def pass_entity_names(mentions: DataFrame, claims: DataFrame) -> DataFrame:
    """The distinct names that a pass touches: mentions and subjects of claims."""
    keys = ["run_id", "pass_no"]
    rows = mentions.select(*keys, "name").unionByName(claims.select(*keys, F.col("entity").alias("name")))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("names"))
