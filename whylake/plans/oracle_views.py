"""SQL definitions of the role views over the given tables (see ``tables.py`` for the DataFrame form)."""

FILE_OF_PART = """CASE WHEN m < 3 THEN 'deps/pkg' || m || '.lock' WHEN m < 10 THEN 'docs/guide' || m || '.md'
  WHEN m < 25 THEN 'tests/test_mod' || m || '.py' ELSE 'src/area' || (m % 7) || '/mod' || m || '.py' END"""

VIEWS = {
    "v_all": """
SELECT *, concat_ws(chr(10), 'Order ' || k || ' of customer ' || cust, 'Vibe-Decision: ' || dec,
                    'Vibe-Watch: ' || watch, 'Vibe-Rejected: ' || rej) AS body
FROM (
  SELECT '/fleet/p' || (o_custkey // 100) AS project, sha1(CAST(o_orderkey AS VARCHAR)) AS sha,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 1000000000000 + o_orderkey AS log_pos,
    o_orderdate AS date, 'dev' || o_custkey AS author,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'fix: ' WHEN '2' THEN 'feat(core): ' WHEN '3' THEN 'refactor: '
      WHEN '4' THEN 'Update ' ELSE 'chore: ' END || 'order ' || o_orderkey AS subject,
    (o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM') AS is_merge,
    o_orderkey AS k, o_custkey AS cust, o_orderstatus AS st, o_totalprice AS price,
    CASE WHEN o_orderstatus = 'F' THEN 'ship order ' || o_orderkey || ' in one batch' END AS dec,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'order ' || o_orderkey || ' may exceed budget' END AS watch,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'split order ' || o_orderkey END AS rej
  FROM orders)""",
    "v_commits": "SELECT * FROM v_all WHERE NOT is_merge",
    "v_files": f"""
SELECT c.project, c.sha, c.log_pos, c.date, {FILE_OF_PART} AS file
FROM (SELECT DISTINCT l_orderkey, l_partkey % 100 AS m FROM lineitem) JOIN v_commits c ON c.k = l_orderkey""",
    "v_tracked": f"""
SELECT DISTINCT project, {FILE_OF_PART} AS file
FROM (SELECT l_orderkey, l_partkey % 100 AS m FROM lineitem WHERE l_quantity >= 49) JOIN v_commits ON k = l_orderkey""",
    "v_hunks": f"""
SELECT * FROM (
  SELECT c.project, c.sha, c.log_pos, c.date, {FILE_OF_PART} AS file, CAST(l_linenumber AS BIGINT) * 40 AS new_start,
    CAST(l_quantity AS BIGINT) AS new_count, CAST(l_linenumber AS BIGINT) * 40 AS old_start, CAST(l_quantity AS BIGINT) - 1 AS old_count
  FROM (SELECT *, l_partkey % 100 AS m FROM lineitem) JOIN v_commits c ON c.k = l_orderkey)
WHERE file NOT LIKE '%.lock'""",
    "v_renames": f"""
SELECT project, log_pos, old, {FILE_OF_PART} AS new FROM (SELECT project, log_pos, m + 1 AS m, {FILE_OF_PART} AS old FROM (
  SELECT project, log_pos, 25 + k % 70 AS m FROM v_commits WHERE k % 37 = 0))""",
    "v_narr": """
SELECT coalesce(c.project, '/fleet/unfiled' || (d.doc_id // 100)) AS project, coalesce(c.sha, sha1('d' || d.doc_id)) AS sha, coalesce(c.log_pos, d.doc_id) AS log_pos,
  coalesce(c.date, TIMESTAMP '1970-01-01') AS date, d.doc_id, 'Order ' || d.doc_id || ' in ' || lang AS what, text AS why,
  list_filter([CASE WHEN lang = 'en' THEN 'keep ' || source END, c.dec], lambda x: x IS NOT NULL) AS decisions,
  list_filter([c.watch, CASE WHEN d.n_chars > 1500 THEN 'check ' || lang || ' copy' END,
    CASE WHEN d.n_chars < 300 THEN '材料不足,无法判断' END], lambda x: x IS NOT NULL) AS risks,
  list_filter([CASE WHEN lang IN ('fr', 'es') THEN 'translate ' || source END,
    CASE WHEN d.n_chars < 300 THEN '  ' END], lambda x: x IS NOT NULL) AS open_loops,
  list_filter([CASE WHEN lang = 'es' THEN 'drop ' || source END, c.rej], lambda x: x IS NOT NULL) AS rejected,
  CAST(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_evidence, coalesce(l.toxic = 1, false) AS degraded,
  TIMESTAMP '2024-01-01' + to_seconds(d.doc_id) AS created_at
FROM documents d LEFT JOIN v_all c ON c.k = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "v_evidence": """
SELECT n.project, n.sha, 'c' || n.doc_id AS session_id, 'claude' AS source, n.created_at AS ts, CASE WHEN len(n.decisions) > 0 THEN 'high' ELSE 'low' END AS confidence,
  coalesce(list_slice(s.asked, 1, 2), []) AS prompts, coalesce(list_slice(s.told, 1, 1), []) AS excerpts
FROM v_narr n LEFT JOIN (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS asked, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS told
  FROM conversations GROUP BY 1) s ON s.conv_id = n.doc_id WHERE n.n_evidence > 0""",
    "v_caps": """
SELECT sha || ':0' AS capsule_id, project, sha, watch AS risk, CAST(date AS DATE) AS sealed_date,
  CAST(date AS DATE) + 21 AS open_date, CASE WHEN st <> 'O' THEN CAST(date AS DATE) + 21 END AS opened_date,
  CASE WHEN st = 'F' THEN '已解决' END AS outcome
FROM v_commits WHERE watch IS NOT NULL""",
    "v_reviewed": """
SELECT project, sha, date + INTERVAL 10 DAY AS reviewed_at FROM v_commits WHERE price >= 250000""",
    "v_requests": """
SELECT project, sha, k AS number, 'Request ' || k AS title, 'wanted by ' || author AS snippet FROM v_commits WHERE price BETWEEN 100000 AND 180000 AND k % 3 = 0""",
    "v_actions": """
SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'cursor' WHEN 'error' THEN 'codex' ELSE 'claude' END AS source,
  '/fleet/u' || user_id AS project, user_id || ':' || strftime(ts, '%Y-%m-%d') AS session_id,
  CASE event_type WHEN 'view' THEN 'read' ELSE 'write' END AS mode,
  'src/k' || json_extract_string(props, '$.k') || '.py' AS file, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS n
FROM events WHERE event_type <> 'purchase'""",
    "v_sess": """
SELECT project, source, session_id, min(ts) AS started, max(ts) AS ended, count(*) AS records
FROM v_actions GROUP BY ALL""",
    "v_sess_files": "SELECT DISTINCT project, source, session_id, file, mode FROM v_actions",
    "v_sess_texts": """
SELECT project, source, session_id, list_slice(list('what does ' || file || ' do' ORDER BY file) FILTER (WHERE mode = 'read'), 1, 20) AS prompts,
  list_slice(list('changed ' || file ORDER BY file) FILTER (WHERE mode = 'write'), 1, 12) AS excerpts FROM v_sess_files GROUP BY ALL""",
    "v_ecommits": """
SELECT '/fleet/u' || user_id AS project, sha1('e' || event_id) AS sha, event_id AS log_pos, ts AS date,
  'feat: purchase ' || event_id AS subject, 'src/k' || json_extract_string(props, '$.k') || '.py' AS file
FROM events WHERE event_type = 'purchase'""",
    "v_turns": """
SELECT 'c' || conv_id AS session_id, '/chat/' || (conv_id // 50) AS project, turn AS line_no, role, text,
  conv_id || ':' || turn AS turn_id, TIMESTAMP '2024-02-01' + to_seconds(conv_id * 60 + turn) AS ts
FROM conversations""",
    "v_usage": """
SELECT event_type AS command, '/fleet/u' || user_id AS project, ts, n % 3 AS llm_calls, n AS tokens_in,
  n * 2 AS tokens_out, n * 7 AS cache_hit_tokens, event_id
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events)""",
    "v_url_paths": """
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  '/' || regexp_extract(url, '^https?://([^?#]+)', 1) AS path, url FROM pages""",
    "v_digests": """
SELECT project, CAST(date AS DATE) AS day, count(*) AS commits,
  '今日 ' || count(*) || ' 个 commit:' || array_to_string(list_slice(list(subject ORDER BY log_pos), 1, 3), ';') AS overview,
  coalesce(arg_min(first_decision, log_pos) FILTER (WHERE first_decision IS NOT NULL), '') AS decision
FROM (SELECT c.project, c.date, c.log_pos, c.subject, n.decisions[1] AS first_decision
      FROM v_commits c LEFT JOIN v_narr n ON n.sha = c.sha) GROUP BY 1, 2""",
}
