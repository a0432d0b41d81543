"""The event log: validation, numbering, routing, progress and tails. All functions take and return DataFrames."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_EVENT_BYTES = 8 << 10
MAX_BODY_BYTES = 1 << 20
MAX_SUBJECT_BYTES = 256
WINDOW_EVENTS, READY_EVENTS, IDLE_SECONDS, TAIL_EVENTS = 200, 20, 2.0, 50
#: Kinds of machine chatter, kept but never distilled.
SKIP_KINDS = ["tool_log", "tool_result", "trace", "stack_trace", "log", "debug", "heartbeat"]


def parsed(payload: Column) -> Column:
    return F.try_parse_json(payload)


def field(value: Column, path: str) -> Column:
    """A member of a parsed payload: null where absent, a parsed null where null."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def json_type(value: Column) -> Column:
    return F.when(value.isNotNull(), F.schema_of_variant(value))


def string_field(value: Column, path: str) -> Column:
    x = field(value, path)
    return F.when(json_type(x) == "STRING", F.try_variant_get(value, f"$.{path}", "string"))


def is_object(value: Column) -> Column:
    return F.coalesce(json_type(value).startswith("OBJECT"), F.lit(False))


def tenant_scope(df: DataFrame, project_id: str) -> DataFrame:
    """Rows of one project; no project is an error."""
    if not project_id:
        raise ValueError("a project is required")
    return df.where(F.col("project_id") == project_id)


def assign_seq(events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Adds seq: 1, 2, ... within each run by time and id, after the run's head where `runs` gives one."""
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "id")).cast("long")
    if runs is None:
        return events.withColumn("seq", order)
    heads = runs.select("run_id", F.col("last_seq").alias("_head"))
    return events.withColumn("seq", order).join(heads, "run_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_head", F.lit(0))).drop("_head")


def backfill_seq(events: DataFrame) -> DataFrame:
    """Numbers events without a seq after the greatest of their run."""
    run = Window.partitionBy("run_id")
    missing = F.col("seq").isNull()
    nth = F.row_number().over(Window.partitionBy("run_id", missing).orderBy("created_at", "id"))
    return events.withColumn("seq", F.when(missing, F.coalesce(F.max("seq").over(run), F.lit(0)) + nth).otherwise(F.col("seq")))


def run_heads(events: DataFrame, runs: DataFrame) -> DataFrame:
    heads = events.groupBy("run_id").agg(F.max("seq").alias("_head"))
    return runs.join(heads, "run_id", "left").withColumn("last_seq", F.greatest("last_seq", F.coalesce("_head", F.lit(0)))).drop("_head")


def gated_reason(payload: Column, max_bytes: int = MAX_EVENT_BYTES) -> Column:
    size = F.octet_length(payload)
    kind = string_field(parsed(payload), "kind")
    return F.when(size > max_bytes, F.concat(F.lit("size:"), size.cast("string"))).when(kind.isin(SKIP_KINDS), F.concat(F.lit("kind:"), kind))


def gate_events(events: DataFrame, max_bytes: int = MAX_EVENT_BYTES) -> DataFrame:
    return events.withColumn("gated_reason", gated_reason(F.col("payload"), max_bytes))


def _is_state(value: Column) -> Column:
    return F.coalesce(string_field(value, "kind") == "state", F.lit(False))


def is_state(payload: Column) -> Column:
    return _is_state(parsed(payload))


def route_events(events: DataFrame) -> DataFrame:
    """route: state first, then gated, else window."""
    payload = F.col("payload")
    return events.withColumn("route", F.when(is_state(payload), "state").when(gated_reason(payload).isNotNull(), "gated").otherwise("window"))


def _subject_reason(value: Column, path: str) -> Column:
    raw, text = field(value, path), string_field(value, path)
    return (
        F.when(raw.isNull() | (json_type(raw) == "VOID") | (text == ""), "is required")
        .when(text.isNull(), "must be a string")
        .when(F.octet_length(text) > MAX_SUBJECT_BYTES, f"exceeds {MAX_SUBJECT_BYTES} bytes")
        .when(text.rlike(r"\p{Cc}"), "contains a control character")
    )


def _fact_value(value: Column) -> Column:
    """The member `value` of a parsed fact as JSON."""
    found = field(value, "value")
    return F.when(json_type(found) == "VOID", F.lit("null")).otherwise(F.to_json(found))


def parse_state_facts(events: DataFrame, cap: int | None = MAX_EVENT_BYTES) -> DataFrame:
    """State events with entity, predicate and value (JSON), or the field and reason of the error. cap None: stored facts."""
    rows = events.where(is_state(F.col("payload"))).withColumn("_v", parsed(F.col("payload")))
    v = F.col("_v")
    rows = rows.withColumns({"_entity": _subject_reason(v, "entity"), "_predicate": _subject_reason(v, "predicate"), "_text": _fact_value(v)})
    size = F.octet_length("_text") > (cap or 2**31 - 1)
    rows = rows.withColumn("_value", F.when(F.col("_text").isNull(), "is required").when(size, f"exceeds {cap} bytes"))
    where = F.when(F.col("_entity").isNotNull(), "entity").when(F.col("_predicate").isNotNull(), "predicate").when(F.col("_value").isNotNull(), "value")
    rows = rows.withColumn("error_field", where).withColumn("error_reason", F.coalesce("_entity", "_predicate", "_value"))
    good = F.col("error_field").isNull()
    rows = rows.withColumns({"entity": F.when(good, string_field(v, "entity")), "predicate": F.when(good, string_field(v, "predicate")), "value": F.when(good, F.col("_text"))})
    return rows.drop("_v", "_entity", "_predicate", "_text", "_value")


def decode_state_facts(events: DataFrame) -> DataFrame:
    return parse_state_facts(events, None).where("error_field IS NULL").drop("error_field", "error_reason")


def ingest_events(raw: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and rejects with a code. All that a payload tells is told where it lies, so that only codes and the
    columns that are asked for meet the runs; a payload that is too large is not parsed."""
    v, text = F.col("_v"), _fact_value(F.col("_v"))
    wrong = [_subject_reason(v, "entity").isNotNull(), _subject_reason(v, "predicate").isNotNull(), text.isNull(), F.octet_length(text) > MAX_EVENT_BYTES]
    told = raw.withColumn("_large", F.octet_length("payload") > MAX_BODY_BYTES).withColumn("_v", parsed(F.when(~F.col("_large"), F.col("payload"))))
    first = F.when(F.col("_large"), "too_large").when(F.coalesce(F.col("agent_id"), F.lit("")) == "", "agent_required").when(~is_object(v), "payload_not_object")
    told = told.withColumns({"_first": first, "_bad_fact": _is_state(v) & reduce(or_, wrong)}).drop("_large", "_v")
    known = runs.select("run_id", F.lit(True).alias("_known"))
    code = F.coalesce("_first", F.when(F.col("_known").isNull(), "unknown_run").when(F.col("_bad_fact"), "invalid_state_fact"))
    marked = told.join(known, "run_id", "left").withColumn("reject_code", code).drop("_known", "_first", "_bad_fact")
    return marked.where("reject_code IS NULL").drop("reject_code"), marked.where("reject_code IS NOT NULL")


def upsert_working_facts(facts: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The value of the highest seq per project, run, entity and predicate; a stale write changes nothing."""
    columns = ["project_id", "run_id", "entity", "predicate", "value", "seq", "agent_id"]
    rows = facts.select(*columns) if current is None else facts.select(*columns).unionByName(current.select(*columns))
    newest = rows.groupBy("project_id", "run_id", "entity", "predicate").agg(F.max_by(F.struct("value", "seq", "agent_id"), "seq").alias("x"))
    return newest.select("project_id", "run_id", "entity", "predicate", "x.value", "x.seq", "x.agent_id")


def uncovered(events: DataFrame, runs: DataFrame) -> DataFrame:
    return events.join(runs.select("run_id", "covered_seq"), "run_id").where("seq > covered_seq")


def uncovered_events(events: DataFrame, runs: DataFrame, limit: int | None = WINDOW_EVENTS) -> DataFrame:
    """Events past the mark of their run in order: the first `limit` of each run (a window of the job), or all with None."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    rows = uncovered(events, runs).withColumn("nth", nth)
    return rows if limit is None else rows.where(F.col("nth") <= limit)


def window_ends(events: DataFrame, runs: DataFrame, limit: int = WINDOW_EVENTS) -> DataFrame:
    """_mark and _end of each run that has events past its mark: the window of its first `limit` such events lies after
    _mark and up to _end. Only runs and seqs are sorted."""
    seqs = uncovered_events(events.select("run_id", "seq"), runs.select("run_id", "covered_seq").hint("shuffle_hash"), limit)
    return seqs.groupBy("run_id").agg(F.max("covered_seq").alias("_mark"), F.max("seq").alias("_end"))


def pass_window(events: DataFrame, ends: DataFrame) -> DataFrame:
    """The events of each run's window, as they are. They stream past the ends, one row of each run, and are not sorted,
    so that a task's memory doesn't grow with payloads."""
    return events.join(ends.hint("shuffle_hash"), "run_id").where("seq > _mark AND seq <= _end").drop("_mark", "_end")


def window_plan(events: DataFrame, runs: DataFrame, size: int = WINDOW_EVENTS) -> DataFrame:
    """pass_no: the pass in which each uncovered event is read."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    return uncovered(events, runs).withColumn("pass_no", F.ceil(nth / size).cast("int"))


def micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def run_readiness(events: DataFrame, runs: DataFrame, now: Column, max_events: int = READY_EVENTS, idle_s: float = IDLE_SECONDS) -> DataFrame:
    newest = uncovered(events, runs).groupBy("run_id").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))
    out = runs.select("run_id").join(newest, "run_id", "left")
    idle = F.coalesce((micros(now) - micros(F.col("newest"))) / 1e6, F.lit(0.0))
    out = out.select("run_id", F.coalesce("n", F.lit(0)).alias("event_count"), idle.alias("idle_seconds"))
    return out.withColumn("ready", (F.col("event_count") > 0) & ((F.col("event_count") >= max_events) | (F.col("idle_seconds") >= idle_s)))


def freshness_lag(events: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    oldest = uncovered(events, runs).groupBy("run_id").agg(F.min_by("created_at", "seq").alias("oldest"))
    lag = F.coalesce(F.floor((micros(now) - micros(F.col("oldest"))) / 1000), F.lit(0)).cast("long")
    return runs.select("run_id").join(oldest, "run_id", "left").select("run_id", lag.alias("freshness_lag_ms"))


def min_seq_check(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """error_code of each request: unknown run, or a min_seq above the head of its run."""
    out = requests.join(runs.select("run_id", "last_seq"), "run_id", "left")
    return out.withColumn("error_code", F.when(F.col("last_seq").isNull(), "unknown_run").when(F.col("min_seq") > F.col("last_seq"), "min_seq_ahead"))


def raw_tail(requests: DataFrame, events: DataFrame, runs: DataFrame, tail_max: int = TAIL_EVENTS) -> DataFrame:
    """Per request the events up to min_seq that the mark doesn't cover, all of them, and the newest beyond, at most
    tail_max; truncated where more were there."""
    asked = requests.join(runs.select("run_id", "covered_seq"), "run_id")
    rows = asked.join(events.select("run_id", "seq", "agent_id", "payload"), "run_id").where("seq > covered_seq")
    beyond = F.col("seq") > F.col("min_seq")
    back = F.row_number().over(Window.partitionBy("pack_id", beyond).orderBy(F.desc("seq")))
    rows = rows.withColumn("_back", F.when(beyond, back))
    rows = rows.withColumn("truncated", F.coalesce(F.max("_back").over(Window.partitionBy("pack_id")), F.lit(0)) > tail_max)
    return rows.where(F.col("_back").isNull() | (F.col("_back") <= tail_max)).drop("_back")


def authorize(rows: DataFrame, action: str) -> DataFrame:
    return rows.withColumn("allowed", F.array_contains("scopes", action) | F.array_contains("scopes", "*"))
