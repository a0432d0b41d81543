"""Measurements over events, packs, legs and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.text import leg_status

from .events import gated_reason, is_state, uncovered

#: Upper bounds of histogram buckets.
LATENCY_SECONDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.15, 0.25, 0.5, 1.0, 2.5, 5.0]
FRESHNESS_SECONDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
CANDIDATES = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
SIMILARITY = [0.7, 0.8, 0.85, 0.88, 0.9, 0.92, 0.94, 0.96, 0.98, 1.0]


def histogram(rows: DataFrame, value: str, bounds: list[float], *keys: str) -> DataFrame:
    """le, n, total, rows: how many values are at most each bound, and the sum and number of all; one pass, one row per
    bound (and set of keys). The last row is without bound."""
    counts = rows.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("rows"), F.sum(value).alias("total"))
    listed = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("rows").alias("n")))
    return counts.select(*keys, "total", "rows", F.inline(listed)).select(*keys, "le", "n", "total", "rows")


def bucket_quantile(hist: DataFrame, q: float, *keys: str) -> DataFrame:
    """The least bound under which a share q of the values lies; null if only the unbounded row does."""
    return hist.groupBy(*keys).agg(F.min(F.when(F.col("n") >= q * F.col("rows"), F.col("le"))).alias("quantile"))


def gate_rates(events: DataFrame) -> DataFrame:
    state, gated = is_state(F.col("payload")), gated_reason(F.col("payload")).isNotNull()
    n = events.agg(
        F.count("*").alias("ingested"), F.count_if(state).alias("state_routed"), F.count_if(~state & gated).alias("gated"), F.count_if(~state & ~gated).alias("extracted")
    )
    return n.withColumn("pass_rate", F.col("extracted") / (F.col("extracted") + F.col("gated")))


def backlog(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Uncovered events and the oldest of them, by project and run."""
    return uncovered(events, runs.select("run_id", "covered_seq")).groupBy("project_id", "run_id").agg(F.count("*").alias("pending"), F.min("created_at").alias("oldest"))


def leg_stats(legs: DataFrame) -> DataFrame:
    """Candidates of each leg by query, with the class of its status; a leg without results is one row without an id."""
    return legs.groupBy("query_id", "leg").agg(F.count("id").alias("candidates"), F.max(leg_status(F.col("status"))).alias("status_class"))


def dropped_legs(legs: DataFrame) -> DataFrame:
    """query_id and the sorted legs that ran out of time."""
    return legs.groupBy("query_id").agg(F.array_sort(F.collect_set(F.when(F.col("status") == "timeout", F.col("leg")))).alias("degraded"))


def pack_metrics(packs: DataFrame) -> DataFrame:
    """Packs, those over budget, those with a cut tail, and the 95th percentile of the lag."""
    over = (F.col("budget") > 0) & (F.col("source_tokens") > F.col("budget"))
    p95 = F.percentile("freshness_lag_ms", 0.95)
    return packs.agg(F.count("*").alias("packs"), F.count_if(over).alias("budget_exceeded"), F.count_if("truncated").alias("tail_truncated"), p95.alias("p95_lag_ms"))


def pin_model(projects: DataFrame, writes: DataFrame) -> DataFrame:
    """The model of a project: what was set, else that of its first write."""
    first = writes.groupBy("project_id").agg(F.min_by("model_id", "arrival").alias("_first"))
    return projects.join(first, "project_id", "left").withColumn("active_model_id", F.coalesce("active_model_id", "_first")).drop("_first")


def model_mismatch(projects: DataFrame, embeddings: DataFrame) -> DataFrame:
    """state per project and model of its vectors: UNSET, MATCH or MISMATCH; a pinned project without vectors matches."""
    used = embeddings.groupBy("project_id", "model_id").agg(F.count("*").alias("vectors"))
    pin, own = F.col("active_model_id"), F.col("model_id")
    state = F.when(pin.isNull(), "UNSET").when(own.isNull() | (pin == own), "MATCH").otherwise("MISMATCH")
    return projects.join(used, "project_id", "left").withColumn("state", state)


def missing_vectors(projects: DataFrame, memories: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Live memories of pinned projects without a vector in the project's model."""
    pinned = projects.where("active_model_id IS NOT NULL").select("project_id", F.col("active_model_id").alias("model_id"))
    wanted = memories.join(pinned, "project_id")
    return wanted.join(embeddings.select(F.col("memory_id").alias("id"), "model_id"), ["id", "model_id"], "left_anti")


def metering(rows: DataFrame) -> DataFrame:
    return rows.groupBy("op").agg(F.sum("count").alias("total"))


