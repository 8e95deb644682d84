"""Queries on debt, graph, alignment and drift."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from whylake.operators import align as A
from whylake.operators import debt as D
from whylake.operators import drift as R
from whylake.operators import graph as G
from whylake.plans.registry import query

TODAY = date(2001, 9, 1)
TODAY_SQL = "DATE '2001-09-01'"

DEBT_SQL = f"""
SELECT b.project, b.file, round(churn * (1 + greatest(0, {TODAY_SQL} - coalesce(review, touch)) / 30.0)
   * (1 - (reviewed + caps_filled)::DOUBLE / (commits + caps_total)), 6) AS debt_exact,
  churn, reviewed, commits, caps_filled, caps_total, nullif(last_decision, '') AS last_decision
FROM (
  SELECT f.project, f.file, CAST(sum(coalesce(len(n.decisions), 0) + 1) AS BIGINT) AS churn,
    count(DISTINCT f.sha) AS commits, count(DISTINCT r.sha) AS reviewed,
    CAST(sum(coalesce(k.caps, 0)) AS BIGINT) AS caps_total, CAST(sum(coalesce(k.filled, 0)) AS BIGINT) AS caps_filled,
    max(CAST(r.reviewed_at AS DATE)) AS review, max(CAST(f.date AS DATE)) AS touch,
    arg_max(coalesce(n.decisions[1], ''), (f.date, -f.log_pos)) AS last_decision
  FROM v_files f LEFT JOIN v_narr n ON n.sha = f.sha LEFT JOIN v_reviewed r ON r.sha = f.sha
  LEFT JOIN (SELECT sha, count(*) AS caps, count(outcome) AS filled FROM v_caps GROUP BY sha) k ON k.sha = f.sha
  GROUP BY 1, 2) b JOIN v_tracked t ON t.project = b.project AND t.file = b.file"""


def board(t):
    return D.debt_board(t.files(), t.narratives(), t.capsules(), t.reviewed(), t.tracked(), TODAY)


@query("debt_board", DEBT_SQL)
def debt_board(t):
    return board(t).drop("debt")


@query("debt_top", f"""
WITH board AS ({DEBT_SQL}) SELECT project, file, rank, churn FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY debt_exact DESC, file) AS rank FROM board) WHERE rank <= 3""")
def debt_top(t):
    return D.debt_top(board(t), 3).select("project", "file", F.col("rank").cast("bigint").alias("rank"), "churn")


@query("debt_drilldown", """
SELECT f.project, f.file, i.kind, f.sha, i.item, i.detail FROM v_files f JOIN v_tracked t USING (project, file) JOIN (
  SELECT n.sha, 'unreviewed' AS kind, c.subject AS item, array_to_string(n.decisions, ' | ') AS detail
  FROM v_narr n JOIN v_commits c USING (sha) WHERE len(n.decisions) > 0 AND n.sha NOT IN (SELECT sha FROM v_reviewed)
  UNION ALL SELECT sha, 'pending_capsule', capsule_id, risk FROM v_caps WHERE opened_date IS NOT NULL AND outcome IS NULL
) i ON i.sha = f.sha""")
def debt_drilldown(t):
    return D.debt_drilldown(t.commits(), t.files(), t.narratives(), t.capsules(), t.reviewed(), t.tracked())


GRAPH_CTES = """
WITH scope AS (
  SELECT *, (count(*) OVER (PARTITION BY project)) - back AS ts FROM (
    SELECT c.*, row_number() OVER (PARTITION BY c.project ORDER BY c.log_pos DESC) AS back FROM v_commits c) WHERE back <= 200),
info AS (
  SELECT s.project, s.sha, s.date, s.subject, s.ts, coalesce(s.dec, n.decisions[1]) AS text,
    CASE WHEN s.dec IS NOT NULL THEN 'breadcrumb' WHEN n.decisions[1] IS NOT NULL THEN 'narrative' ELSE 'change' END AS kind
  FROM scope s LEFT JOIN v_narr n ON n.sha = s.sha),
touched AS (SELECT i.project, i.sha, i.ts, i.kind, f.file FROM info i JOIN v_files f ON f.sha = i.sha),
pairs AS (
  SELECT DISTINCT a.project, a.sha AS from_sha, a.ts AS from_ts, b.sha AS to_sha, b.ts AS to_ts
  FROM touched a JOIN touched b ON a.project = b.project AND a.file = b.file AND b.ts > a.ts WHERE a.kind <> 'change'),
degrees AS (
  SELECT i.project, i.sha, i.ts, count(p.to_sha) AS out_degree FROM info i
  LEFT JOIN pairs p ON p.from_sha = i.sha WHERE i.kind <> 'change' GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY out_degree DESC, ts DESC) AS rank
  FROM degrees) WHERE rank <= 40),
edges AS (SELECT project, from_sha, to_sha FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.from_sha ORDER BY p.to_ts DESC) AS r
  FROM pairs p JOIN ranked k ON k.sha = p.from_sha) WHERE r <= 8),
nodes AS (
  SELECT i.project, i.sha, strftime(i.date, '%Y-%m-%d') AS day, i.subject,
    CASE WHEN k.sha IS NOT NULL THEN i.text ELSE '' END AS text,
    CASE WHEN k.sha IS NOT NULL THEN i.kind ELSE 'change' END AS kind,
    CASE WHEN k.sha IS NOT NULL AND c.sha IS NOT NULL THEN '胶囊:' || coalesce(c.outcome, '待验证') ELSE '' END AS badge,
    i.ts, k.out_degree
  FROM info i LEFT JOIN ranked k ON k.sha = i.sha LEFT JOIN v_caps c ON c.sha = i.sha
  WHERE k.sha IS NOT NULL OR i.sha IN (SELECT to_sha FROM edges))
"""


def graph(t):
    return G.decision_graph(t.commits(), t.files(), t.narratives(), t.capsules())


@query("graph_edges", GRAPH_CTES + "SELECT * FROM edges")
def graph_edges(t):
    return graph(t)[1]


@query("graph_nodes", GRAPH_CTES + "SELECT * FROM nodes")
def graph_nodes(t):
    return graph(t)[0].withColumn("ts", F.col("ts").cast("bigint"))


@query("graph_canvas", GRAPH_CTES + """
SELECT project, substr(sha256(substr(sha, 1, 7)), 1, 16) AS id,
  '[' || substr(sha, 1, 7) || '] ' || coalesce(nullif(text, ''), nullif(subject, ''), substr(sha, 1, 7))
    || CASE WHEN badge <> '' THEN chr(10) || badge ELSE '' END AS text,
  ts * 450 AS x, ((row_number() OVER (PARTITION BY project ORDER BY ts) - 1) % 8) * 140 AS y,
  CASE kind WHEN 'breadcrumb' THEN '5' WHEN 'narrative' THEN '6' END AS color FROM nodes""")
def graph_canvas(t):
    return G.canvas_nodes(graph(t)[0])


# Projects of events hold one user each; their purchases play commits.
ALIGN_CTES = """
WITH timed AS (
  SELECT c.project, c.sha, s.source, s.session_id FROM v_ecommits c JOIN v_sess s ON s.project = c.project
    AND c.date >= s.started - INTERVAL 30 MINUTE AND c.date <= s.ended + INTERVAL 30 MINUTE),
shared AS (
  SELECT c.project, c.sha, f.source, f.session_id, list(DISTINCT f.file) AS files
  FROM v_ecommits c JOIN v_sess_files f ON f.project = c.project AND f.file = c.file AND f.mode = 'write' GROUP BY ALL),
matches AS (
  SELECT coalesce(t.project, s.project) AS project, coalesce(t.sha, s.sha) AS sha, coalesce(t.source, s.source) AS source,
    coalesce(t.session_id, s.session_id) AS session_id, coalesce(array_to_string(list_sort(s.files), ','), '') AS overlap,
    CAST(coalesce(len(s.files), 0) AS BIGINT) AS n_overlap,
    CASE WHEN t.sha IS NOT NULL AND s.sha IS NOT NULL THEN 'high' ELSE 'low' END AS confidence
  FROM timed t FULL OUTER JOIN shared s USING (project, sha, source, session_id))
"""


def matches(t):
    commits = t.event_commits()
    return A.align(commits, commits, t.sessions(), t.session_files())


@query("align", ALIGN_CTES + "SELECT * FROM matches")
def align(t):
    return matches(t).withColumn("overlap", F.array_join("overlap", ","))


@query("evidence_top2", ALIGN_CTES + """
SELECT project, sha, source, session_id, confidence, rank, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended,
  coalesce(array_to_string(list_slice(prompts, 1, 3), ' | '), '') AS prompts, coalesce(array_to_string(list_slice(excerpts, 1, 2), ' | '), '') AS excerpts FROM (
  SELECT m.*, s.ended, x.prompts, x.excerpts, row_number() OVER (PARTITION BY m.sha
     ORDER BY m.confidence <> 'high', n_overlap DESC, m.source, m.session_id) AS rank
  FROM matches m JOIN v_sess s USING (project, source, session_id) LEFT JOIN v_sess_texts x USING (project, source, session_id)) WHERE rank <= 2""")
def evidence_top2(t):
    sessions = t.sessions().join(t.session_texts(), A.SESSION, "left")
    commits = t.event_commits()
    best = A.best_sessions(commits, commits, t.sessions(), t.session_files())
    return A.evidence(best, sessions).select(
        "project", "sha", "source", "session_id", "confidence", F.col("rank").cast("bigint").alias("rank"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ended"), *(
            F.coalesce(F.array_join(c, " | "), F.lit("")).alias(c) for c in ("prompts", "excerpts")))


@query("session_commits", ALIGN_CTES + """
SELECT m.project, m.source, m.session_id, substr(c.sha, 1, 7) AS sha7, c.subject, min(c.log_pos) AS log_pos
FROM matches m JOIN v_ecommits c USING (sha) GROUP BY ALL""")
def session_commits(t):
    return A.session_commits(matches(t), t.event_commits())


@query("drift", """
SELECT project, source, session_id, count(*) AS written, count(*) FILTER (WHERE landed) AS committed,
  coalesce(array_to_string(list(file ORDER BY file) FILTER (WHERE NOT landed), ','), '') AS missing
FROM (
  SELECT s.project, s.source, s.session_id, f.file,
    EXISTS (SELECT 1 FROM v_ecommits c WHERE c.project = s.project AND c.file = f.file
            AND c.date >= s.started - INTERVAL 30 MINUTE) AS landed
  FROM v_sess s JOIN v_sess_files f USING (project, source, session_id) WHERE f.mode = 'write')
GROUP BY ALL""")
def drift(t):
    rows = R.drift_files(t.sessions(), t.session_files(), t.event_commits())
    return R.drift(rows).withColumn("missing", F.array_join("missing", ","))
