"""DuckDB SQL of the adapter views, to put before an oracle query."""

EVENTS = """
ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
v_events AS (SELECT event_id AS id, 'p' || (user_id % 3) AS project_id, CAST(user_id AS VARCHAR) AS run_id, event_type AS agent_id, ts AS created_at, k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE event_type WHEN 'signup' THEN '{"kind":"state","entity":"user","predicate":"p' || (k % 5) || '","value":' || k || '}'
    WHEN 'error' THEN '{"kind":"log","k":' || k || '}' WHEN 'view' THEN '{"kind":"heartbeat"}'
    WHEN 'click' THEN '{"note":"Clicked item ' || (k % 20) || '."}'
    ELSE '{"claim":{"entity":"item' || (k % 10) || '","predicate":"price","value":' || k || '}}' END AS payload FROM ev0),
v_runs AS (SELECT project_id, run_id, max(seq) AS last_seq, CAST(floor(max(seq) * 0.25) AS BIGINT) AS covered_seq FROM v_events GROUP BY ALL),
v_open AS (SELECT e.*, r.covered_seq FROM v_events e JOIN v_runs r USING (run_id) WHERE e.seq > r.covered_seq)"""

MEMORIES = """
v_memories AS (SELECT d.doc_id AS id, 'p' || (d.doc_id % 3) AS project_id, ['semantic', 'episodic', 'procedural'][CAST(d.doc_id % 3 + 1 AS INT)] AS kind, d.text AS content,
  ['src:' || d.source, 'lang:' || d.lang] AS scope_keys, CASE WHEN l.toxic = 1 THEN 'quarantine' ELSE 'normal' END AS trust_tier,
  TIMESTAMP '2024-01-01' + to_seconds(d.doc_id) AS created_at, CASE WHEN d.doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01' + to_seconds(d.doc_id) END AS valid_to,
  CAST(NULL AS BIGINT) AS superseded_by FROM documents d LEFT JOIN labels l USING (doc_id)),
v_live AS (SELECT * FROM v_memories WHERE valid_to IS NULL AND superseded_by IS NULL),
v_search AS (SELECT * FROM v_live WHERE trust_tier <> 'quarantine'),
v_emb AS (SELECT vec_id AS memory_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"""

DENSE = """
qs AS (SELECT vec_id AS query_id, 'p' || (vec_id % 3) AS project_id, CASE WHEN vec_id % 40 = 20 THEN ['lang:en'] ELSE [] END AS scopes, d.text FROM embeddings JOIN documents d ON d.doc_id = vec_id WHERE vec_id % 20 = 0),
dq AS (SELECT qs.*, vec FROM qs JOIN v_emb ON memory_id = query_id),
dd AS (SELECT query_id, m.id, 1 - list_cosine_similarity(dq.vec, e.vec) AS distance FROM dq JOIN v_search m USING (project_id) JOIN v_emb e ON e.memory_id = m.id WHERE len(scopes) = 0 OR list_has_any(scope_keys, scopes)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS pos FROM dd) WHERE pos <= 50)"""

STOP = "('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','with')"


WORDS = "'[^\\p{L}\\p{N}]+'"


def lexical(source: str = "v_search") -> str:
    """Words, alternatives and minus words of the queries, and the covers of each match: from each place of a word the
    nearest end at which an alternative is complete, of which the shortest stretch for each end counts."""
    return f"""
lq AS (SELECT query_id, project_id, scopes, list_slice(list_filter(regexp_split_to_array(lower(text), {WORDS}), lambda w: length(w) > 5), 1, 3) AS ws FROM qs),
lw AS (SELECT DISTINCT query_id, project_id, scopes, CASE WHEN query_id % 100 = 0 AND nth > 1 THEN 1 ELSE 0 END AS part, query_id % 100 = 40 AND nth = 2 AS minus, word
  FROM (SELECT query_id, project_id, scopes, unnest(ws) AS word, generate_subscripts(ws, 1) AS nth FROM lq) WHERE word NOT IN {STOP} AND NOT (query_id % 100 = 40 AND nth = 3)),
ln AS (SELECT query_id, part, count(DISTINCT word) AS need FROM lw WHERE NOT minus GROUP BY ALL),
ls AS (SELECT id, project_id, scope_keys, regexp_split_to_array(lower(content), {WORDS}) AS ws FROM {source}),
lm AS (SELECT * FROM (SELECT id, project_id, scope_keys, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM ls) WHERE word IN (SELECT word FROM lw)),
lo AS (SELECT lw.query_id, id, part, minus, lw.word, pos FROM lw JOIN lm USING (project_id, word) WHERE len(scopes) = 0 OR list_has_any(scope_keys, scopes)),
lg AS (SELECT query_id, id, part, need FROM lo JOIN ln USING (query_id, part) GROUP BY ALL HAVING count(DISTINCT CASE WHEN NOT minus THEN word END) = need AND NOT bool_or(minus)),
le AS (SELECT DISTINCT query_id, id, pos FROM lo WHERE NOT minus AND (query_id, id) IN (SELECT (query_id, id) FROM lg)),
lx AS (SELECT e.query_id, e.id, e.pos AS first, o.part, o.word, need, min(o.pos) AS nxt FROM le e JOIN lo o USING (query_id, id) JOIN lg USING (query_id, id, part) WHERE NOT minus AND o.pos >= e.pos GROUP BY ALL),
ly AS (SELECT query_id, id, first, part, max(nxt) AS last FROM lx GROUP BY query_id, id, first, part, need HAVING count(*) = need),
lc AS (SELECT query_id, id, last, max(first) AS first FROM (SELECT query_id, id, first, min(last) AS last FROM ly GROUP BY ALL) GROUP BY ALL),
lr AS (SELECT c.query_id, c.id, c.first, c.last, count(*) AS inside FROM lc c JOIN le e ON e.query_id = c.query_id AND e.id = c.id AND e.pos BETWEEN c.first AND c.last GROUP BY ALL),
lk AS (SELECT query_id, id, sum(0.1 / (1 + last - first - (inside - 1))) AS rank FROM lr GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9) DESC, id) AS pos FROM lk) WHERE pos <= 50)"""


FUSED = """
legs AS (SELECT query_id, id, pos, 'dense' AS leg, 'ok' AS status_class FROM dense UNION ALL SELECT query_id, id, pos, 'lexical', 'ok' FROM lexical UNION ALL SELECT query_id, NULL, NULL, 'entity', 'stub' FROM qs),
once AS (SELECT query_id, leg, id, min(pos) AS pos FROM legs WHERE id IS NOT NULL GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, leg ORDER BY pos, id) AS leg_rank FROM once),
fs AS (SELECT query_id, id, sum(1.0 / (60 + leg_rank)) AS score FROM rk GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(score / 1e-4) AS BIGINT) DESC, id) AS pos FROM fs)"""

VERDICTS = """
v_verdicts AS (SELECT 'own' AS system, 'answer' AS protocol, trial, l.doc_id || CASE WHEN l.doc_id % 10 = 0 THEN '_abs' ELSE '' END AS question_id, d.source AS question_type,
  CASE WHEN (l.doc_id + trial) % 7 = 0 THEN 1 - quality ELSE quality END AS correct FROM labels l JOIN documents d USING (doc_id), (SELECT unnest([0, 1, 2]) AS trial)),
v_recall AS (SELECT * FROM v_verdicts WHERE NOT suffix(question_id, '_abs'))"""

CLAIMS = """
v_claims AS (SELECT id, project_id, run_id, seq AS source_seq, 'item' || (k % 10) AS entity, 'price' AS predicate, CAST(k AS VARCHAR) AS value,
  created_at AS arrival FROM v_events WHERE agent_id = 'purchase')"""

TWINS = """
tw0 AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, list_transform(embedding, lambda x, i: CASE WHEN i <= 12 THEN 0.0 ELSE CAST(x AS DOUBLE) END) AS c FROM embeddings),
v_near AS (SELECT vec_id AS id, vec_id % 50 AS bucket, v AS vec FROM tw0 UNION ALL
  SELECT vec_id + 1000000, vec_id % 50, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) FROM tw0)"""


def sql(*views: str, select: str) -> str:
    return "WITH " + ",".join(views) + "\n" + select
