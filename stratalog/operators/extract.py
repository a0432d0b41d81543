"""Candidates from event payloads: memories, claims and entities, their hygiene and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.text import lenient_timestamp

from .events import field, is_object, json_type, parsed, string_field

MEMORY_KEYS = ["memory", "content", "note"]
KINDS = ["working", "episodic", "semantic", "procedural"]


def extract_memories(events: DataFrame) -> DataFrame:
    """At most one memory per event: the first of the keys that holds a string."""
    v = parsed(F.col("payload"))
    content = F.coalesce(*[string_field(v, k) for k in MEMORY_KEYS])
    out = events.where(is_object(v)).withColumn("content", content).where("content IS NOT NULL")
    return out.withColumn("kind", F.lit("semantic"))


def _is_text(value: Column) -> Column:
    """Whether a member decodes as a string: it is one, null or absent."""
    return F.coalesce(json_type(value).isin("STRING", "VOID"), F.lit(True))


def _text(value: Column) -> Column:
    """A string member; null and absent ones are empty."""
    return F.coalesce(F.when(json_type(value) == "STRING", F.try_variant_get(value, "$", "string")), F.lit(""))


def _list(value: Column) -> Column:
    """The elements of an array, or null."""
    return F.when(json_type(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def extract_claims(events: DataFrame) -> DataFrame:
    """One claim per event whose key `claim` decodes as a whole: entity and predicate are strings (null and absent ones
    are empty), event_time is an RFC 3339 time, null or absent. If one part doesn't decode, the event has no claim."""
    v = parsed(F.col("payload"))
    entity, predicate, value, at = (field(v, f"claim.{k}") for k in ("entity", "predicate", "value", "event_time"))
    time = lenient_timestamp(_text(at))
    timed = F.coalesce(json_type(at) == "VOID", F.lit(True)) | (_is_text(at) & time.isNotNull())
    good = is_object(v) & is_object(field(v, "claim")) & _is_text(entity) & _is_text(predicate) & timed
    text = F.when(json_type(value) == "VOID", F.lit("null")).otherwise(F.to_json(value))
    return events.where(good).withColumns({"entity": _text(entity), "predicate": _text(predicate), "value": text, "event_time": time})


def extract_entities(events: DataFrame) -> DataFrame:
    """name, type and aliases of each mention, by place, of events whose key `entities` decodes as a whole: a list of
    objects (or nulls) whose names and types are strings and whose aliases are lists of strings. Null and absent
    strings are empty; if one part doesn't decode, the event has no mentions."""

    def member(e: Column, key: str) -> Column:
        return F.try_variant_get(e, f"$.{key}", "variant")

    def decodes(e: Column) -> Column:
        aliases = member(e, "aliases")
        listed = F.coalesce(json_type(aliases) == "VOID", F.lit(True)) | F.coalesce(F.forall(_list(aliases), _is_text), F.lit(False))
        return (json_type(e) == "VOID") | (is_object(e) & _is_text(member(e, "name")) & _is_text(member(e, "type")) & listed)

    v = parsed(F.col("payload"))
    found = _list(field(v, "entities"))
    rows = events.where(is_object(v)).withColumn("_all", found).where(F.coalesce(F.forall("_all", decodes), F.lit(False)))
    rows = rows.select("*", F.posexplode("_all").alias("pos", "_e")).drop("_all")
    aliases = F.transform(_list(member(F.col("_e"), "aliases")), _text)
    return rows.withColumns({"name": _text(member(F.col("_e"), "name")), "type": _text(member(F.col("_e"), "type")), "aliases": aliases}).drop("_e")


def clean_candidates(candidates: DataFrame) -> DataFrame:
    """Unknown kinds become semantic, empty content goes, bad times are null, and a window of one event takes any seq."""
    w = Window.partitionBy("run_id", "pass_no")
    low, high = F.min("window_seq").over(w), F.max("window_seq").over(w)
    out = candidates.where(F.trim("content") != "").withColumn("kind", F.when(F.col("kind").isin(KINDS), F.col("kind")).otherwise("semantic"))
    out = out.withColumn("event_time", lenient_timestamp(F.col("event_time")))
    return out.withColumn("source_seq", F.when(low == high, low).otherwise(F.col("source_seq")))


def resolve_provenance(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates whose source event is in the window, with its id and agent; claims without a JSON value go."""
    source = events.select("run_id", F.col("seq").alias("source_seq"), F.col("id").alias("source_event_id"), F.col("agent_id").alias("created_by"))
    out = candidates.join(source, ["run_id", "source_seq"])
    return out.where(parsed(F.col("value")).isNotNull()) if "value" in candidates.columns else out
