"""Passes with exact and near merges against a serial loop."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from stratalog.operators import consolidate, fold
from stratalog.operators.consolidate import consolidate_pass

CANDIDATE = "project_id string, context_hash string, content_hash string, arrival long, id long, vec array<double>, content string, agent_id string, source_seq long"


def serial(rows, memories, cap, merge=0.92, gray=0.85):
    """Memories by id and version rows after the rows, one at a time over plain lists."""
    live = [m | {"touched": False, "new": False} for m in memories]
    versions, outcomes = [], []
    for r in rows:
        own = [m for m in live if (m["project_id"], m["context_hash"]) == (r["project_id"], r["context_hash"])]
        same = sorted((m for m in own if m["content_hash"] == r["content_hash"]), key=lambda m: m["id"])
        newest = sorted(own, key=lambda m: m["order"])[-cap:]
        near = max(newest, key=lambda m: (round(float(np.dot(m["vec"], r["vec"])), 9), -m["id"]), default=None)
        cosine = None if near is None else float(np.dot(near["vec"], r["vec"]))
        if same:
            target, kind = same[0], "exact_merged"
        elif near is not None and cosine >= merge:
            target, kind = near, "near_merged"
        else:
            live.append({k: r[k] for k in ("project_id", "context_hash", "content_hash", "id", "vec", "content")} | {"version": 1, "order": (1, r["arrival"]), "new": True})
            outcomes.append((r["id"], "inserted", r["id"], cosine is not None and cosine >= gray))
            continue
        versions.append((target["id"], target["version"], target["content"], r["agent_id"]))
        target["version"] += 1
        if kind == "near_merged":
            target |= {k: r[k] for k in ("content_hash", "vec", "content")}
        target["touched"] = True
        outcomes.append((r["id"], kind, target["id"], False))
    return live, versions, outcomes


def sample(rng, first, n):
    rows = []
    for i in range(first, first + n):
        angle = rng.choice([0.0, 0.1, 0.2, 0.5, 0.62, 1.2, 1.25, 2.0]) + rng.choice([0, 0, 0.01])
        text = f"a{angle:.2f}"
        context = f"c{rng.randint(0, 3)}"
        rows.append({"project_id": f"p{i % 2}", "context_hash": context, "content_hash": f"{context}-{text}", "arrival": i, "id": i, "vec": [float(np.cos(angle)), float(np.sin(angle))], "content": text, "agent_id": f"g{i % 3}", "source_seq": i})
    return rows


def test_two_passes_equal_a_serial_loop(spark):
    rng, cap = random.Random(9), 3
    first, second = sample(rng, 0, 60), sample(rng, 100, 120)
    live, _, _ = serial(first, [], cap)
    want, versions, outcomes = serial(second, live, cap)
    df = lambda rows: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in CANDIDATE.split(", ")) for r in rows], CANDIDATE).repartition(3)
    one = fold.fold_candidates(df(first), cap=cap)
    stored = fold.folded_memories(one, df(first)).withColumnRenamed("memory_id", "id").withColumn("created_at", F.col("id"))
    assert sorted((r.id, r.version, r.content) for r in stored.collect()) == sorted((m["id"], m["version"], m["content"]) for m in live)
    two = fold.fold_candidates(df(second), stored, cap=cap)
    contents = df(second).unionByName(stored.select("id", "content", "content_hash", "vec"), allowMissingColumns=True)
    assert sorted((r.id, r.outcome, r.memory_id, r.gray) for r in two.collect()) == sorted(outcomes)
    assert {r.outcome for r in two.collect()} == {"inserted", "exact_merged", "near_merged"}
    kept = {r.memory_id: (r.version, r.content, r.content_hash, [round(x, 9) for x in r.vec]) for r in fold.folded_memories(two, contents).collect()}
    assert kept == {m["id"]: (m["version"], m["content"], m["content_hash"], [round(x, 9) for x in m["vec"]]) for m in want if m.get("touched") or m.get("new") and m["id"] >= 100}
    found = fold.folded_versions(two, contents).collect()
    assert sorted((r.memory_id, r.version, r.content, r.changed_by) for r in found) == sorted(versions)
    assert all(r.reason.startswith(("merged duplicate content from event seq ", "near-duplicate (cosine ")) for r in found)


def test_pass_with_vectors(spark):
    """A near memory is one memory with a history, in the result of the pass and in the vectors to store."""
    log = spark.createDataFrame([(i, "p", "r", "g", i, f'{{"note":"value {v}"}}') for i, v in enumerate((10, 11, 10, 50, 11), 1)], "id long, project_id string, run_id string, agent_id string, seq long, payload string")
    log = log.withColumn("created_at", F.timestamp_seconds("seq"))
    runs = spark.createDataFrame([("p", "r", 5, 0)], "project_id string, run_id string, last_seq long, covered_seq long")
    angle = lambda text: F.split(text, " ")[1].cast("double") / 50
    embed = lambda text: F.array(F.cos(angle(text)), F.sin(angle(text)))
    now = F.timestamp_seconds(F.lit(1000))
    one = consolidate_pass(log.where("seq <= 3"), runs, now, embed=embed)
    assert [(r.memory_id, r.version, r.content, r.inserted) for r in one["memories"].collect()] == [(1, 3, "value 10", True)]
    assert sorted((r.version, r.content) for r in one["versions"].collect()) == [(1, "value 10"), (2, "value 11")]
    held = one["memories"].withColumnRenamed("memory_id", "id").withColumn("created_at", F.col("id"))
    marks = runs.withColumn("covered_seq", F.lit(3).cast("long"))
    two = consolidate_pass(log, marks, now, memories=held, vectors=one["vectors"], embed=embed)
    assert sorted((r.memory_id, r.version, r.content, r.inserted, r.rewritten) for r in two["memories"].collect()) == [(1, 4, "value 11", False, True), (4, 1, "value 50", True, True)]
    assert [(r.memory_id, r.version, r.content) for r in two["versions"].collect()] == [(1, 3, "value 10")]
    assert sorted(r.memory_id for r in two["vectors"].collect()) == [1, 4] and sorted(r.outcome for r in two["outcomes"].collect()) == ["inserted", "near_merged"]


def test_no_sort_of_a_pass_holds_payloads(spark, monkeypatch):
    """What a task sorts to find the windows is runs and seqs, and candidates meet their vectors without the payload."""
    plans, columns, stored = {}, {}, consolidate.stored

    def kept(df, name):
        plans[name] = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        columns[name] = df.columns
        return stored(df, name)

    monkeypatch.setattr(consolidate, "stored", kept)
    log = spark.createDataFrame([(i, "p", f"r{i % 2}", "g", i, f'{{"note":"value {i % 7}"}}') for i in range(1, 41)], "id long, project_id string, run_id string, agent_id string, seq long, payload string")
    log = log.withColumn("created_at", F.timestamp_seconds("seq"))
    runs = spark.createDataFrame([("p", "r0", 40, 10), ("p", "r1", 39, 0)], "project_id string, run_id string, last_seq long, covered_seq long")
    embed = lambda text: F.array(F.lit(1.0), F.lit(0.0))
    out = consolidate_pass(log, runs, F.timestamp_seconds(F.lit(1000)), 5, embed=embed)
    assert sorted((r.run_id, r.covered_seq, r.events) for r in out["marks"].collect()) == [("r0", 20, 5), ("r1", 9, 5)]
    assert sorted(r.id for r in out["outcomes"].collect()) == [1, 3, 5, 7, 9, 12, 14, 16, 18, 20]
    held = re.findall(r"\) (?:Sort|SortMergeJoin.*)\n(?:Input|Left output).*?: (\[.*\])", plans["ends"] + plans["window"])
    assert held and not any("payload" in h for h in held)
    assert "payload" in columns["window"] and "payload" not in columns["candidates"]
