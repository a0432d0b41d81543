"""One consolidation pass over every run that is due."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.sources.shared import stored

from .claims import claims_union, pass_entity_names, register_entities, resolve_claims_lww
from .dedup import exact_dedup, fingerprints
from .events import WINDOW_EVENTS, decode_state_facts, pass_window, route_events, run_readiness, window_ends
from .extract import extract_claims, extract_entities, extract_memories
from .fold import CONTEXT, fold_candidates, folded_memories, folded_versions


def consolidate_pass(
    events: DataFrame, runs: DataFrame, now: Column, limit: int = WINDOW_EVENTS, *, memories: DataFrame | None = None,
    claims: DataFrame | None = None, entities: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, vectors: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """memories, versions, claims, entities and marks of a pass; with `embed`, vectors and outcomes also.

    The window of each ready run is its first `limit` uncovered events. State events become claims beside those that
    are extracted. The entities of the whole pass are part of each fingerprint. The mark moves to the last event read.
    What earlier passes left goes in: live memories (project_id, content_hash, id, version, content), active claims and
    the registry of entities.

    `embed` makes vectors of contents, of each different one once. Candidates then merge into memories of their context
    exactly or by nearness, in one chain of versions (fold.fold_candidates); `memories` needs context_hash and
    created_at too, and `vectors` (project_id, memory_id, vec) holds what was stored for them, so that no stored
    content is embedded again. `vectors` of the result are those to store, `outcomes` one row per candidate.
    """
    # What is found by run is stored in steps, so that no stage holds the sorts and tables of all of them at a time.
    ready = run_readiness(events, runs.hint("shuffle_hash"), now).where("ready").select("run_id")
    ready = stored(runs.join(ready, "run_id", "left_semi").select("run_id", "covered_seq"), "ready")
    ends = stored(window_ends(events, ready, limit), "ends")
    window = pass_window(events, ends).withColumn("pass_no", F.lit(1))
    # Every output reads the window; stored, it is sorted and routed once, in tasks of its own.
    window = stored(route_events(window), "window")
    routed = window
    reading = routed.where("route = 'window'").drop("route")
    own = ["project_id", "run_id", "entity", "predicate", "value", "source_seq"]
    found = extract_claims(reading).withColumnRenamed("seq", "source_seq").select(*own)
    facts = decode_state_facts(routed.where("route = 'state'").drop("route")).withColumnRenamed("seq", "source_seq").select(*own)
    when = F.struct("source_seq", "run_id", "source_ord")
    new_claims = claims_union(found, facts).withColumn("arrival", when).withColumn("id", F.concat_ws(":", "run_id", "source_seq", "source_ord"))
    mentions = extract_entities(reading)
    names = pass_entity_names(mentions.select("run_id", "pass_no", "name"), new_claims.withColumn("pass_no", F.lit(1)))
    candidates = extract_memories(reading).join(names.select("run_id", F.col("names").alias("entity_names")), "run_id", "left")
    candidates = fingerprints(candidates).withColumn("source_seq", F.col("seq")).withColumn("arrival", F.struct("seq", "run_id"))
    if embed is None:
        kept, versions = exact_dedup(candidates, memories)
        more = {}
    else:
        kept, versions, more = _folded(candidates, memories, vectors, embed)
    seen = mentions.select("project_id", "name", "type", "aliases", F.struct(F.col("seq").alias("source_seq"), "run_id", F.lit(0).alias("source_ord")).alias("arrival"))
    return more | {
        "memories": kept, "versions": versions, "claims": resolve_claims_lww(new_claims, stored=claims), "entities": register_entities(seen, new_claims, entities),
        "marks": window.groupBy("run_id").agg(F.max("seq").alias("covered_seq"), F.count("*").alias("events")),
    }


def _folded(candidates: DataFrame, memories: DataFrame | None, vectors: DataFrame | None, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Memories, versions, and vectors and outcomes of a pass with near merges."""
    fresh = candidates.select("content").distinct().withColumn("vec", embed(F.col("content")))
    # Each of these feeds several outputs.
    rows = stored(candidates.select("id", *CONTEXT, "content", "content_hash", "arrival", "agent_id", "source_seq").join(fresh, "content"), "candidates")
    columns = ["id", "content", "content_hash", "vec", "agent_id", "source_seq"]
    contents, held = rows.select(*columns), None
    if memories is not None:
        known = vectors.select("project_id", F.col("memory_id").alias("id"), "vec")
        held = memories.drop("vec").join(rows.select(*CONTEXT).distinct(), CONTEXT, "left_semi").join(known, ["project_id", "id"], "left")
        contents = contents.unionByName(held.select("id", "content", "content_hash", "vec"), allowMissingColumns=True)
    outcomes = stored(fold_candidates(rows, held), "outcomes")
    kept = folded_memories(outcomes, contents)
    changed = kept.where("rewritten").select("project_id", "memory_id", "vec")
    return kept, folded_versions(outcomes, contents), {"vectors": changed, "outcomes": outcomes}
