"""Small cases with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import text as t
from stratalog.operators import claims, dedup, evaluate, events, extract, inspect, metrics, pack, retrieve, textsearch
from stratalog.sources import questions


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(("text", "expected"), [("\tQueue  drained;\n", "queue drained"), ("Ünïcode? Yes: ", "ünïcode? yes"), ("!?", ""), ("a.b, c", "a.b, c")])
def test_normalize_content(spark, text, expected):
    assert value(spark, t.normalize_content(F.lit(text))) == expected


def test_fingerprints(spark):
    one = lambda kind, names, text: value(spark, t.content_fingerprint(F.lit(kind), F.array(*map(F.lit, names)).cast("array<string>"), F.lit(text)))
    assert one("semantic", ["queue", "disk"], "Full") == one("semantic", ["disk", "queue"], " full. ")
    # Lengths are part of it: what moves from a name to the text, or from one name to the next, makes another one.
    assert len({one("semantic", names, text) for names, text in ((["ab"], "c"), (["a"], "bc"), (["a", "b"], "c"), ([], "abc"))}) == 4
    assert one("semantic", [], "x") != one("episodic", [], "x")
    none = value(spark, t.content_fingerprint(F.lit("semantic"), F.lit(None).cast("array<string>"), F.lit("x")))
    assert none == one("semantic", [], "x")
    assert value(spark, t.context_fingerprint(F.lit("semantic"), F.lit(None).cast("array<string>"))) != one("semantic", [], "")


def test_gate(spark):
    """Every kind of chatter is gated by name, a payload just over the limit by size, one just at it and others not."""
    limit, pad = 64, lambda n: '{"v":"' + "é" * ((n - 8) // 2) + '"}'
    payloads = [f'{{"kind":"{k}","n":{i}}}' for i, k in enumerate(events.SKIP_KINDS)] + [pad(limit), pad(limit + 2), '{"kind":"Debug"}', '{"kind":["trace"]}', '{"nested":{"kind":"trace"}}', '"trace"', "{"]
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, payload string")
    found = [r.gated_reason for r in events.gate_events(df, limit).orderBy("id").collect()]
    n = len(events.SKIP_KINDS)
    assert found == [f"kind:{k}" for k in events.SKIP_KINDS] + [None, f"size:{limit + 2}"] + [None] * 5 and n == 7


def test_state_facts(spark):
    """Each subject field in turn is absent, empty, of another type, too long or with a control character."""
    good = {"kind": "state", "entity": "pump-4", "predicate": "mode", "value": {"on": [1, None]}}
    bad = {"is required": [None, ""], "must be a string": [1.5, ["x"], {"k": 1}, True], f"exceeds {events.MAX_SUBJECT_BYTES} bytes": ["ü" * 129], "contains a control character": ["x\u0007", "\u0085y"]}
    cases = [(good | {f: x}, f, reason) for f in ("entity", "predicate") for reason, values in bad.items() for x in values]
    cases += [({k: x for k, x in good.items() if k != f}, f, "is required") for f in ("entity", "predicate", "value")]
    cases += [(good | {"value": "w" * events.MAX_EVENT_BYTES}, "value", f"exceeds {events.MAX_EVENT_BYTES} bytes"), (good, None, None), (good | {"value": None, "entity": "ü" * 128}, None, None)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _, _) in enumerate(cases)] + [(99, json.dumps(good | {"kind": "State"}))], "id long, payload string")
    found = {r.id: r for r in events.parse_state_facts(df).collect()}
    assert [(found[i].error_field, found[i].error_reason) for i in range(len(cases))] == [(f, reason) for _, f, reason in cases] and 99 not in found
    assert [json.loads(found[i].value) for i in (len(cases) - 2, len(cases) - 1)] == [good["value"], None]


def test_extraction_priority(spark):
    cases = ['{"note":"third","content":"second"}', '{"memory":["a"],"content":"","note":"x"}', '{"content":false,"note":"kept"}', '"memory"', '{"other":"x"}']
    df = spark.createDataFrame(list(enumerate(cases)), "id long, payload string")
    assert rows(extract.extract_memories(df), "id", "content") == [(0, "second"), (1, ""), (2, "kept")]


def test_field_merge(spark):
    """Random chains of objects and plain values against a loop over dictionaries."""
    rng = random.Random(12)
    chains = {f"s{n}": [rng.choice(["true", '"t"', "[3]"]) if rng.random() < 0.2 else json.dumps({rng.choice("uvwxyz"): rng.randint(0, 9) for _ in range(rng.randint(1, 3))}, separators=(",", ":")) for _ in range(rng.randint(1, 6))] for n in range(30)}
    data = [("p", e, "a", i, i, v) for e, values in chains.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "project_id string, entity string, predicate string, id long, arrival long, value string").repartition(3)
    want = []
    for e, values in chains.items():
        state, merges = None, 0
        for v in map(json.loads, values):
            merges = (merges + 1 if isinstance(state, dict) else 1) if isinstance(v, dict) else 0
            state = {**state, **v} if isinstance(v, dict) and isinstance(state, dict) else v
        want.append((e, json.dumps(state, sort_keys=True), "field-merge" if merges > 1 else "last-write-wins"))
    found = [(r.entity, json.dumps(json.loads(r.value), sort_keys=True), r.reason) for r in claims.resolve_claims_merge(df).collect()]
    assert sorted(found) == sorted(want)


def test_field_merge_history(spark):
    values = ['{"x\\"y":1,"b":[2]}', '{"b":null}', "7", '{"z":{"k":1}}', '{"a":"ä","z":3}', "{}"]
    df = spark.createDataFrame([("p", "e", "a", i, i, v) for i, v in enumerate(values)], "project_id string, entity string, predicate string, id long, arrival long, value string")
    state, expected = None, []
    for v in map(json.loads, values):
        state = {**state, **v} if isinstance(v, dict) and isinstance(state, dict) else v
        expected.append(state)
    found = claims.merge_history(df).orderBy("id").collect()
    assert [json.loads(r.value) for r in found] == expected
    assert [r.reason for r in found] == ["last-write-wins", "field-merge", "last-write-wins", "last-write-wins", "field-merge", "field-merge"]
    assert [r.superseded_by for r in found] == [1, 2, 3, 4, 5, None]
    for n in range(1, len(values) + 1):
        assert json.loads(claims.resolve_claims_merge(df.where(f"id < {n}")).first().value) == expected[n - 1]
    # The same in two passes.
    first = claims.merge_history(df.where("id < 2")).where("superseded_by IS NULL")
    assert [json.loads(r.value) for r in claims.merge_history(df.where("id >= 2"), first).orderBy("id").collect()] == expected[1:]


def test_stored_state(spark):
    columns = "project_id string, content_hash string, id long, agent_id string, source_seq long, arrival long, content string"
    new = spark.createDataFrame([("p", "h", 5, "a", 50, 5, "X"), ("p", "h", 6, "b", 60, 6, "x!"), ("p", "i", 7, "a", 70, 7, "y"), ("q", "h", 8, "a", 80, 8, "X")], columns)
    stored = spark.createDataFrame([("p", "h", 1, 3, "x"), ("p", "h", 2, 1, "x."), ("p", "j", 3, 1, "z")], "project_id string, content_hash string, id long, version int, content string")
    kept, versions = dedup.exact_dedup(new, stored)
    assert rows(kept, "project_id", "memory_id", "version", "content", "inserted") == [("p", 1, 5, "x", False), ("p", 7, 1, "y", True), ("q", 8, 1, "X", True)]
    assert rows(versions, "memory_id", "version", "content", "changed_by") == [(1, 3, "x", "a"), (1, 4, "x", "b")]
    closed = stored.withColumn("valid_to", F.when(F.col("id") == 1, F.current_timestamp()))
    assert rows(dedup.exact_dup_probe(new, closed), "id", "duplicate_of") == [(5, 2), (6, 2), (7, None), (8, None)]
    own = "id string, project_id string, entity string, predicate string, run_id string, source_seq long, arrival long, value string"
    active = spark.createDataFrame([("old", "p", "e", "a", "r", 9, 99, "1"), ("else", "p", "f", "a", "r", 9, 99, "1")], own)
    found = claims.resolve_claims_lww(spark.createDataFrame([("n1", "p", "e", "a", "r", 1, 1, "2"), ("n2", "p", "e", "a", "r", 2, 2, "3")], own), stored=active)
    assert rows(found, "id", "superseded_by") == [("n1", "n2"), ("n2", None), ("old", "n1")]


def test_near_dedup_at_length(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 6))
    vec = base[rng.integers(0, 400, 3000)] + rng.normal(size=(3000, 6)) * 0.25
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    bucket, cap, stored = rng.integers(0, 3, 3000), 150, 500
    expected, live = [], {0: [], 1: [], 2: []}
    for i in range(3000):
        own = live[bucket[i]]
        outcome, memory, gray, version, gone = "inserted", i, False, 1, None
        if own and i >= stored:
            cosine, k = max(((round(float(m["vec"] @ vec[i]), 9), -m["id"]), n) for n, m in enumerate(own))
            if cosine[0] >= 0.92:
                m = own[k]
                outcome, memory, version, gone = "near_merged", m["id"], m["version"] + 1, m["last"]
                m.update(vec=vec[i], version=version, last=i)
            else:
                gray = cosine[0] >= 0.85
        if outcome == "inserted":
            live[bucket[i]] = [*own, {"id": i, "vec": vec[i], "version": 1, "last": i}][-cap:]
        if i >= stored:
            expected.append((i, outcome, memory, gray, version, gone))
    df = spark.createDataFrame([(int(bucket[i]), i, i, vec[i].tolist(), 1) for i in range(3000)], "bucket long, arrival long, id long, vec array<double>, version int").repartition(3)
    folded = dedup.near_dedup(df.where(f"id >= {stored}"), cap=cap, memories=df.where(f"id < {stored}"))
    assert rows(folded, "id", "outcome", "memory_id", "gray", "version", "replaced_id") == expected
    assert {o for _, o, *_ in expected} == {"inserted", "near_merged"} and any(g for _, _, _, g, *_ in expected)
    contents = df.select("id", F.concat(F.lit("c"), "id").alias("content"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), "vec", F.lit("a").alias("agent_id"), F.col("id").alias("source_seq"))
    memories, versions = dedup.near_merged(folded, contents)
    last = {m: (v, f"c{i}") for i, _, m, _, v, _ in expected}
    assert {r.memory_id: (r.version, r.content) for r in memories.collect()} == last
    assert rows(versions, "memory_id", "version", "content") == sorted((m, v - 1, f"c{g}") for _, o, m, _, v, g in expected if o == "near_merged")
    assert all(r.reason.startswith("near-duplicate (cosine 0.9") or r.reason.startswith("near-duplicate (cosine 1.0") for r in versions.collect())


def test_search_stays_in_its_project(spark):
    memories = spark.createDataFrame(
        [(1, "p", ["s:a"], "alpha beta", "normal", None), (2, "q", ["s:a"], "alpha beta", "normal", None), (3, "p", ["s:b"], "alpha beta größe", "normal", None), (4, "p", [], "alpha", "quarantine", None), (5, "p", ["s:a"], "alpha", "normal", 9)],
        "id long, project_id string, scope_keys array<string>, content string, trust_tier string, superseded_by long",
    ).withColumns({"kind": F.lit("semantic"), "valid_to": F.lit(None).cast("timestamp")})
    vectors = spark.createDataFrame([(i, p, m, [1.0, i / 10]) for i, p in ((1, "p"), (2, "q"), (3, "p"), (4, "p"), (5, "p")) for m in ("m1", "m2")], "memory_id long, project_id string, model_id string, vec array<double>")
    queries = spark.createDataFrame([(1, "p", "m1", [], [1.0, 0.1], "ALPHA"), (2, "p", "m2", ["s:b", "s:c"], [1.0, 0.1], "beta GRÖSSE größe"), (3, "q", "m3", [], [1.0, 0.1], "alpha beta"), (4, "x", "m1", [], [1.0, 0.1], "alpha")], "query_id long, project_id string, model_id string, scopes array<string>, vec array<double>, text string")
    live = retrieve.exclude_quarantine(retrieve.live_head(memories))
    assert rows(retrieve.dense_topk(queries, retrieve.with_vectors(live, vectors)), "query_id", "id", "pos") == [(1, 1, 1), (1, 3, 2), (2, 3, 1)]
    assert rows(textsearch.text_topk(queries, live), "query_id", "id") == [(1, 1), (1, 3), (3, 2)]
    assert rows(textsearch.text_topk(queries.withColumn("text", F.lit("Größe")), live), "query_id", "id") == [(1, 3), (2, 3)]
    found = retrieve.hybrid_retrieve(queries, memories, vectors, order=lambda part: sorted(part["id"], reverse=True))
    assert rows(found, "query_id", "id", "pos") == [(1, 1, 2), (1, 3, 1), (2, 3, 1), (3, 2, 1)]
    stats = metrics.leg_stats(retrieve.search_legs(queries, memories, vectors))
    assert ("entity", 0, "stub") in rows(stats.where("query_id = 4"), "leg", "candidates", "status_class")


def test_dense_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    vec, ask = rng.normal(size=(300, 5)), rng.normal(size=(40, 5))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ask)], "query_id long, vec array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(1 - unit(ask) @ unit(vec).T, axis=1)[:, :9]
    assert rows(retrieve.dense_topk(queries, vectors, 9), "query_id", "pos", "id") == sorted((q, n + 1, int(i)) for q, row in enumerate(best) for n, i in enumerate(row))


def test_fusion(spark):
    legs = spark.createDataFrame([(1, "dense", 1, 10), (1, "dense", 2, 20), (1, "lexical", 1, 30), (1, "lexical", 2, 20)], "query_id long, leg string, pos int, id long")
    assert retrieve.rrf_fuse(legs).orderBy("pos").first().id == 20
    twice = spark.createDataFrame([(1, "dense", 1, 10), (1, "dense", 2, 10)], "query_id long, leg string, pos int, id long")
    assert [r.score for r in retrieve.rrf_fuse(twice).collect()] == [pytest.approx(1 / 61)]
    ties = spark.createDataFrame([(1, x, 1, i) for x, i in (("a", 3), ("b", 1), ("c", 2))], "query_id long, leg string, pos int, id long")
    assert [r.id for r in retrieve.rrf_fuse(ties).orderBy("pos").collect()] == [1, 2, 3]


def test_budget(spark):
    """Whole items while they fit; what comes after the first that doesn't is not looked at, however small."""
    sizes = [(1, 1, 7), (1, 2, 12), (2, 1, 30), (2, 2, 1), (3, 1, 4)]  # section, place, bytes: 2, 3, 8, 1 and 1 tokens
    items = spark.createDataFrame([(b, s, p, "w" * n) for b in range(-1, 18) for s, p, n in sizes], "pack_id long, section int, pos int, content string")
    budgets = spark.createDataFrame([(b, b) for b in range(-1, 18)], "pack_id long, budget int")
    kept = {b: n for b, n in pack.budget_fit(items, budgets).groupBy("pack_id").agg(F.sum(F.col("kept").cast("int"))).collect()}
    costs = [2, 5, 13, 14, 15]
    assert kept == {b: 5 if b <= 0 else sum(c <= b for c in costs) for b in range(-1, 18)}
    assert [value(spark, t.est_tokens(F.lit("日" * n))) for n in range(5)] == [0, 1, 2, 3, 3]


def test_lines(spark):
    assert value(spark, t.flatten(F.lit("\rone\n\ntwo\r\n"))) == " one  two  "
    for most in range(1, 14):  # no character is cut in two
        text = "ab日ñ𝄞c"
        whole = next(text[:n] for n in range(len(text), -1, -1) if len(text[:n].encode()) <= most)
        assert value(spark, t.one_line(F.lit(text), most)) == (text if whole == text else whole + "…")
    assert [value(spark, t.agent_label(F.lit(x))) for x in (None, "", "w\nx", "v" * 65)] == ["-", "-", "w x", "v" * 64 + "…"]
    assert [value(spark, t.clamp_int32(F.lit(x))) for x in (-(2**33), 2**31, 5)] == [-(2**31), 2**31 - 1, 5]


def test_raw_tail(spark):
    """All that was asked for and not covered, and the newest beyond, for every place of the mark and of the request."""
    last, most = 9, 3
    log = spark.createDataFrame([(f"m{c}", i, "a", "{}") for c in (0, 4, 9) for i in range(1, last + 1)], "run_id string, seq long, agent_id string, payload string")
    runs = spark.createDataFrame([(f"m{c}", c) for c in (0, 4, 9)], "run_id string, covered_seq long")
    asked = [(100 * c + m, f"m{c}", m) for c in (0, 4, 9) for m in (0, 2, 5, 6, 9)]
    found = events.raw_tail(spark.createDataFrame(asked, "pack_id long, run_id string, min_seq long"), log, runs, most).collect()
    for pack_id, _, m in asked:
        open_ = [i for i in range(1, last + 1) if i > pack_id // 100]
        beyond = [i for i in open_ if i > m]
        own = [r for r in found if r.pack_id == pack_id]
        assert sorted(r.seq for r in own) == [i for i in open_ if i <= m] + beyond[-most:]
        assert all(r.truncated == (len(beyond) > most) for r in own)


def test_near_dedup(spark):
    """The merge limit itself merges, just under it a candidate is flagged, under the lower limit it is not; other buckets are apart."""
    at = lambda cosine: [cosine, (1 - cosine**2) ** 0.5]
    cosines = [dedup.MERGE + 1e-6, dedup.MERGE - 1e-6, dedup.GRAY + 1e-6, dedup.GRAY - 1e-6, -1.0]
    data = [row for b, c in enumerate(cosines) for row in ((b, 1, 2 * b, at(1.0)), (b, 2, 2 * b + 1, at(c)))]
    df = spark.createDataFrame(data, "bucket long, arrival long, id long, vec array<double>").repartition(3)
    second = [(r.outcome, r.gray, r.memory_id - 2 * r.bucket, r.version) for r in dedup.near_dedup(df).where("id % 2 = 1").orderBy("bucket").collect()]
    assert second == [("near_merged", False, 0, 2), ("inserted", True, 1, 1), ("inserted", True, 1, 1), ("inserted", False, 1, 1), ("inserted", False, 1, 1)]


def test_dup_pairs_over_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    vec = rng.normal(size=(60, 4))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(vec)], "id long, bucket long, vec array<double>")
    expected = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and vec[i] @ vec[j] >= 0.85)
    assert rows(dedup.dup_pairs(df, block=7), "a", "b") == expected and expected


def test_report(spark):
    data = [(n, f"k{i}", int(i < 6 - 2 * n)) for n in range(3) for i in range(8)] + [(n, "none_abs", n % 2) for n in range(3)]
    df = spark.createDataFrame(data, "trial int, question_id string, correct int").selectExpr("'s' system", "'answer' protocol", "trial", "question_id", "'t' question_type", "correct")
    lines = {r.line: r for r in evaluate.eval_report(df).collect()}
    assert lines["overall"].mean == 0.5 and lines["overall"].std == 0.25 and lines["overall"].trials == 3
    assert lines["abstention"].mean == pytest.approx(1 / 3)


@pytest.mark.parametrize(("score", "outcome"), [(0.70, "gate_pass"), (0.699, "gate_fail"), (0.95, "gate_pass")])
def test_baseline(spark, score, outcome):
    measured = spark.createDataFrame([("u", "x", False, score)], "universe string, system string, is_reference boolean, accuracy double")
    assert evaluate.baseline_decision(measured, spark.createDataFrame([("u", 0.80)], "universe string, reference double")).first().outcome == outcome


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question_id": "q", "question_type": "t", "question": "?", "answer": "a", "question_date": "d", "haystack_sessions": [[{"role": "user", "content": "hi"}], [{"role": "user", "content": "ho"}]]}]))
    found, turns = questions.load_questions(questions.read_questions(spark, str(tmp_path / "q.json")))
    assert found.count() == 1 and rows(turns, "session_id", "date", "content") == [("session_0", "", "hi"), ("session_1", "", "ho")]
    assert rows(questions.turns_to_events(turns), "payload") == [("user: hi",), ("user: ho",)]


def test_scalars(spark):
    assert value(spark, t.scope_keys(F.create_map(F.lit("run"), F.lit("r1")))) == ["run:r1"]
    assert value(spark, t.lenient_timestamp(F.lit("yesterday"))) is None and value(spark, t.lenient_timestamp(F.lit("2024-05-01T10:00:00Z"))) is not None
    unit = value(spark, t.hash_embedding(F.lit("x")))
    assert len(unit) == 64 and sum(x * x for x in unit) == pytest.approx(1)
    assert value(spark, t.leg_status(F.lit("hnsw"))) == "ok" and value(spark, t.leg_status(F.lit("timeout"))) == "timeout"


def test_tenants(spark, tmp_path):
    df = spark.createDataFrame([(1, "p1"), (2, "p2")], "id long, project_id string")
    inspect.write_tenant_partitions(df, str(tmp_path / "t"))
    inspect.write_tenant_partitions(spark.createDataFrame([(3, "p2")], "id long, project_id string"), str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "id", "project_id") == [(1, "p1"), (3, "p2")]
    with pytest.raises(ValueError):
        events.tenant_scope(df, "")


def test_reranker_must_permute(spark):
    df = spark.createDataFrame([(1, 5, 0.5, 1), (1, 6, 0.4, 2)], "query_id long, id long, score double, pos int")
    assert [r.id for r in retrieve.rerank_head(df, lambda part: [6, 5]).orderBy("pos").collect()] == [6, 5]
    with pytest.raises(Exception, match="permutation"):
        retrieve.rerank_head(df, lambda part: [6, 6]).collect()
