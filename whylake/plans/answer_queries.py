"""Queries on what a question or a review card can be answered from: targets, references and evidence records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions.redact import redact
from whylake.operators import align as A
from whylake.operators import history as H
from whylake.operators import questions as Q
from whylake.operators import rendering, reports, review, search, state
from whylake.operators.ranking import among
from whylake.plans.evidence_queries import _AFTER, CARD_TARGETS_SQL, HITS_CTES, REDACT_CTES, RENDER_SQL, SEG_LISTS, _sql_steps, card_targets, sql_named, topic_hits
from whylake.plans.history_queries import ALIGN_CTES, TODAY, TODAY_SQL
from whylake.plans.notes_queries import SNAPSHOT_SQL, line_walk, snapshot
from whylake.plans.registry import query
from whylake.session import cut_lineage, written

TESTS_SQL = f"""SELECT project, sha, path, names FROM (
  SELECT w.project, w.sha, w.path, ['test_' || s.stem || '_ok', 'test_' || s.stem || '_slow'] AS names, row_number() OVER (PARTITION BY w.sha ORDER BY w.path) AS rank
  FROM (SELECT DISTINCT project, sha, CASE WHEN split_part(file, '/', -1) LIKE 'test\\_%' ESCAPE '\\' THEN file
          ELSE 'tests/test_' || split_part(file, '/', -1) END AS path FROM v_files WHERE file LIKE '%.py') w
  JOIN ({SNAPSHOT_SQL}) s ON s.project = w.project AND s.path = w.path) WHERE rank <= 5"""


def references(t, asked):
    """What is stored behind the commits ``asked`` (sha), each once, and behind no others."""
    only = lambda rows: among(rows, ["sha"], asked)
    refs = H.references(H.test_refs(only(t.files()), snapshot(t)), only(t.requests()))
    return H.stored_references(refs, only(t.evidence()))


# --- evidence records ------------------------------------------------------------------

# Reviewed commits bring a record of their review; good narratives renew the words of their own.
@query("evidence_records", """
WITH own AS (SELECT project, sha, session_id, ts, excerpts, 0 AS place FROM v_evidence),
incoming AS (SELECT r.project, r.sha, 'review' AS session_id, r.reviewed_at AS ts, ['reviewed'] AS excerpts FROM v_reviewed r
  UNION ALL SELECT project, sha, session_id, ts, ['renewed'] FROM v_evidence WHERE confidence = 'high'),
merged AS (SELECT coalesce(o.project, n.project) AS project, coalesce(o.sha, n.sha) AS sha, coalesce(o.session_id, n.session_id) AS session_id,
    coalesce(o.ts, n.ts) AS ts, o.place, coalesce(n.excerpts, o.excerpts) AS excerpts,
    CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'stored' ELSE 'renewed' END AS how
  FROM own o FULL JOIN incoming n ON n.sha = o.sha AND n.project = o.project AND n.session_id = o.session_id AND n.ts = o.ts)
SELECT project, sha, string_agg(session_id || ':' || how, ' ' ORDER BY place NULLS LAST, ts, session_id) AS records,
  md5(coalesce(string_agg(excerpts[1], '|' ORDER BY place NULLS LAST, ts, session_id), '')) AS words FROM merged GROUP BY 1, 2""")
def evidence_records(t):
    blank = F.array().cast("array<string>")
    review_rows = t.reviewed().select(
        "project", "sha", F.lit("review").alias("session_id"), F.lit("review").alias("source"), F.col("reviewed_at").alias("ts"),
        F.lit("high").alias("confidence"), blank.alias("prompts"), F.array(F.lit("reviewed")).alias("excerpts"))
    own = t.evidence().select("project", "sha", F.inline("evidence")).filter("confidence = 'high'")
    incoming = review_rows.unionByName(own.withColumn("excerpts", F.array(F.lit("renewed"))))
    merged = state.merge_evidence(t.evidence(), incoming)
    first = F.filter(F.transform("evidence", lambda e: F.get(e["excerpts"], F.lit(0))), lambda x: x.isNotNull())
    told = F.transform(F.arrays_zip("evidence", "provenance"), lambda x: F.concat(x["evidence"]["session_id"], F.lit(":"), x["provenance"]))
    return merged.select("project", "sha", F.array_join(told, " ").alias("records"), F.md5(F.array_join(first, "|")).alias("words"))


HIT_SQL = RENDER_SQL.replace("sha", "h.sha")
EVIDENCE_SQL = f"""SELECT sha, '{K.EVIDENCE_TITLE}' || chr(10) || string_agg(concat_ws(chr(10),
    '- [' || source || '·' || substr(session_id, 1, 7) || '·' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '·' || confidence || ']',
    CASE WHEN len(prompts) > 0 THEN '  原话:' || array_to_string(prompts, chr(10) || '  原话:') END,
    CASE WHEN len(excerpts) > 0 THEN '  AI:' || array_to_string(excerpts, chr(10) || '  AI:') END), chr(10) ORDER BY ts)
    || CASE WHEN bool_or(confidence = 'high') THEN '' ELSE chr(10) || '{K.EVIDENCE_LOW_WARN}' END AS block, count(*) AS n FROM v_evidence GROUP BY 1"""
TEST_BLOCK_SQL = f"""SELECT sha, '{K.TEST_REFS_TITLE}' || chr(10) || string_agg('- ' || path || ' — ' || array_to_string(names, '、'), chr(10) ORDER BY path) AS block,
  count(*) AS n FROM ({TESTS_SQL}) GROUP BY 1"""
REQUEST_BLOCK_SQL = f"""SELECT sha, '{K.PR_REFS_TITLE}' || chr(10) || string_agg('- #' || number || ' ' || title || ' — ' || snippet, chr(10) ORDER BY number) AS block,
  count(*) AS n FROM v_requests GROUP BY 1"""


@query("search_hits_references", HITS_CTES + f"""
SELECT question_id, rank, h.sha, coalesce(e.n, 0) AS n_evidence, coalesce(x.n, 0) AS n_tests, coalesce(p.n, 0) AS n_requests,
  md5(CASE WHEN kind = 'conversation' THEN {HIT_SQL} ELSE concat_ws(chr(10), {HIT_SQL}, '  ' || replace(e.block, chr(10), chr(10) || '  '),
    '  ' || replace(x.block, chr(10), chr(10) || '  '), '  ' || replace(p.block, chr(10), chr(10) || '  ')) END) AS text
FROM hits h LEFT JOIN ({EVIDENCE_SQL}) e ON e.sha = h.sha LEFT JOIN ({TEST_BLOCK_SQL}) x ON x.sha = h.sha LEFT JOIN ({REQUEST_BLOCK_SQL}) p ON p.sha = h.sha""")
def search_hits_references(t):
    """Hits with what a reader can check them by, as shown."""
    found = cut_lineage(topic_hits(t))
    rows = search.with_references(found, references(t, F.broadcast(found.select("sha").distinct())))  # eight of each question
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return rows.select(
        "question_id", F.col("rank").cast("bigint").alias("rank"), "sha", n("evidence").alias("n_evidence"), n("test_refs").alias("n_tests"),
        n("pr_refs").alias("n_requests"), F.md5(rendering.hit_with_references()).alias("text"))


# --- targets -----------------------------------------------------------------------------

# Of each project: its first tracked source as a whole since two years, ten lines of it, a lock file (without line data) by
# lines, and a stretch of time.
FIRST_FILE_SQL = "SELECT project, min(file) AS file FROM v_tracked WHERE file LIKE 'src/%' GROUP BY 1"
ASK_SQL = f"""SELECT 'f|' || project AS target_id, project, file, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS "end",
    CAST({TODAY_SQL} - 720 AS TIMESTAMP) AS since, CAST(NULL AS TIMESTAMP) AS until FROM ({FIRST_FILE_SQL})
  UNION ALL SELECT 'l|' || h.project, h.project, h.file, min(h.new_start), min(h.new_start) + 9, NULL, NULL FROM v_hunks h JOIN ({FIRST_FILE_SQL}) f
    ON f.project = h.project AND f.file = h.file GROUP BY h.project, h.file
  UNION ALL SELECT 'k|' || project, project, min(file), 1, 5, NULL, NULL FROM v_files WHERE file LIKE '%.lock' GROUP BY project
  UNION ALL SELECT DISTINCT 't|' || project, project, NULL, NULL, NULL, CAST({TODAY_SQL} - 400 AS TIMESTAMP), CAST({TODAY_SQL} - 35 AS TIMESTAMP) FROM v_commits"""


def ask_targets(t):
    day = lambda n: F.date_sub(F.lit(TODAY), n).cast("timestamp_ntz")
    first = written(t.tracked().filter("file LIKE 'src/%'").groupBy("project").agg(F.min("file").alias("file")))
    none, no_day = F.lit(None).cast("bigint"), F.lit(None).cast("timestamp_ntz")

    def named(rows, kind, file, start, end, since, until):
        return rows.select(F.concat(F.lit(f"{kind}|"), "project").alias("target_id"), "project", file.alias("file"), start.alias("start"), end.alias("end"), since.alias("since"), until.alias("until"))

    begins = among(t.hunks(), ["project", "file"], first).groupBy("project", "file").agg(F.min("new_start").alias("s"))
    locks = t.files().filter("file LIKE '%.lock'").groupBy("project").agg(F.min("file").alias("file"))
    file = F.col("file")
    rows = named(first, "f", file, none, none, day(720), no_day)
    rows = rows.unionByName(named(begins, "l", file, F.col("s"), F.col("s") + 9, no_day, no_day))
    rows = rows.unionByName(named(locks, "k", file, F.lit(1).cast("bigint"), F.lit(5).cast("bigint"), no_day, no_day))
    times = named(t.commits().select("project").distinct(), "t", F.lit(None).cast("string"), none, none, day(400), day(35))
    return rows.unionByName(times)


ASKED_SQL = f"""asked AS ({ASK_SQL}), {line_walk("SELECT target_id, project, file, start, \"end\", CAST(NULL AS BIGINT) AS own_pos FROM asked WHERE target_id LIKE 'l|%'")},
found AS (
  SELECT target_id, 'line' AS kind, sha, log_pos FROM trail
  UNION ALL SELECT a.target_id, 'file', f.sha, f.log_pos FROM asked a JOIN v_files f ON f.project = a.project AND f.file = a.file
    AND (a.target_id LIKE 'f|%' OR a.target_id LIKE 'k|%')
  UNION ALL SELECT a.target_id, 'time', c.sha, c.log_pos FROM asked a JOIN v_commits c ON c.project = a.project AND a.target_id LIKE 't|%'
    AND c.date >= a.since AND c.date < a.until),
newest AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY log_pos DESC) AS rank FROM found),
retrieved AS (SELECT n.* FROM newest n JOIN asked a USING (target_id) JOIN v_commits c ON c.sha = n.sha
  WHERE n.rank <= 50 AND (a.since IS NULL OR c.date >= a.since))"""


@query("ask_targets", f"""
WITH RECURSIVE {SEG_LISTS}, {ASKED_SQL}
SELECT target_id, kind, commits, newest, md5({sql_named("context")}) AS context FROM (
SELECT r.target_id, r.kind, count(*) AS commits, arg_max(r.sha, r.log_pos) AS newest, substr(string_agg(concat_ws(' / ',
    '[' || substr(s.sha, 1, 7) || '] ' || s.subject, CASE WHEN why <> '' THEN '意图:' || substr(why, 1, 200) END,
    CASE WHEN len(decisions) > 0 THEN '决策:' || substr(array_to_string(decisions, ';'), 1, 200) END,
    CASE WHEN len(rejected) > 0 THEN '否决备选:' || substr(array_to_string(rejected, ';'), 1, 200) END,
    CASE WHEN len(risks) > 0 THEN '风险/待验证:' || substr(array_to_string(risks, ';'), 1, 200) END), chr(10) ORDER BY r.log_pos), 1, 6000) AS context
FROM retrieved r JOIN seg s ON s.sha = r.sha GROUP BY 1, 2)""")
def ask_targets_query(t):
    history = Q.retrieve(ask_targets(t), t.commits(), t.files(), t.hunks())
    only = lambda rows: among(rows, H.COMMIT, history)
    return Q.contexts(history, H.segments(only(t.commits()), only(t.narratives()))).withColumn("context", F.md5(redact(F.col("context"))))


@query("ask_references", f"""
WITH RECURSIVE {ASKED_SQL}, items AS (
  SELECT r.target_id, r.log_pos, 'evidence' AS kind, e.session_id || '|' || strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS key FROM retrieved r JOIN v_evidence e ON e.sha = r.sha
  UNION ALL SELECT r.target_id, r.log_pos, 'test', x.path FROM retrieved r JOIN ({TESTS_SQL}) x ON x.sha = r.sha
  UNION ALL SELECT r.target_id, r.log_pos, 'request', CAST(q.number AS VARCHAR) FROM retrieved r JOIN v_requests q ON q.sha = r.sha)
SELECT target_id, kind, key, min(log_pos) AS log_pos FROM items GROUP BY ALL""")
def ask_references(t):
    """Evidence, tests and requests behind each target, every one once."""
    history = Q.retrieve(ask_targets(t), t.commits(), t.files(), t.hunks()).withColumnRenamed("target_id", "target")
    asked = written(history.select("sha").distinct())
    rows = search.reference_rows(history, references(t, asked).drop("project"))
    return rows.select(F.col("target").alias("target_id"), "kind", "key", "log_pos")


# --- cards --------------------------------------------------------------------------------

@query("card_supporting", f"""
WITH RECURSIVE tg AS ({CARD_TARGETS_SQL}), {line_walk("SELECT * FROM tg WHERE line_known")}, seg AS (
  SELECT c.sha, c.log_pos, c.subject, c.dec, c.rej, coalesce(trim(n.why) <> '', false) OR c.dec IS NOT NULL OR c.rej IS NOT NULL OR coalesce(len(n.decisions), 0) > 0
      OR coalesce(len(n.rejected), 0) > 0 OR coalesce(n.n_evidence, 0) > 0 AS has_why
  FROM v_commits c LEFT JOIN v_narr n ON n.sha = c.sha),
hist AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY log_pos DESC) AS r FROM (
    SELECT target_id, sha, log_pos FROM trail
    UNION ALL SELECT t.target_id, f.sha, f.log_pos FROM tg t JOIN v_files f ON NOT t.line_known AND f.project = t.project
      AND f.file = t.file AND f.log_pos < t.own_pos)),
ranked AS (
  SELECT h.target_id, s.*, row_number() OVER (PARTITION BY h.target_id ORDER BY CASE WHEN s.rej IS NOT NULL THEN 0 WHEN s.dec IS NOT NULL THEN 1
      WHEN s.has_why THEN 2 ELSE 3 END, s.log_pos DESC) AS p
  FROM hist h JOIN seg s ON s.sha = h.sha WHERE h.r <= 50)
SELECT target_id, sha, log_pos, subject, has_why FROM ranked WHERE p > 1""")
def card_supporting(t):
    """The other records behind each card."""
    targets = card_targets(t)
    history = review.history_of(targets, t.hunks(), t.files())
    segs = H.segments(t.commits(), t.narratives())
    return review.supporting_records(history, review.review_cards(targets, history, segs), segs).select("target_id", "sha", "log_pos", "subject", "has_why")


# More hunks than are looked at say so; here the limit is small enough to be met.
@query("card_cap", f"""
WITH tg AS ({CARD_TARGETS_SQL}), placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file, start, target_id) AS hunk_no, count(*) OVER (PARTITION BY project) AS total_hunks FROM tg)
SELECT target_id, hunk_no, total_hunks, total_hunks > 10 AS truncated FROM placed WHERE hunk_no <= 10""")
def card_cap(t):
    """The first ten hunks of each project's pending diff."""
    targets = card_targets(t)
    placed = targets.select(F.col("project").alias("diff_id"), "target_id", F.struct("file", "start", "target_id").alias("hunk_no"))
    capped = review.cap_hunks(placed, 10)
    order = F.row_number().over(Window.partitionBy("diff_id").orderBy("hunk_no"))
    return capped.select("target_id", order.cast("bigint").alias("hunk_no"), "total_hunks", "truncated")


# --- the daily report as text --------------------------------------------------------------

# Commits of both kinds: orders carry narratives and capsules, purchases are tied to sessions.
_LIST = "CASE WHEN len({0}) > 0 THEN '**{1}**' || chr(10) || '- ' || array_to_string({0}, chr(10) || '- ') END"
REPORT_SQL = ALIGN_CTES + "," + REDACT_CTES.strip().removeprefix("WITH") + f""",
safe AS (SELECT doc_id, {_sql_steps('t6', _AFTER)} AS why FROM r7),
cm AS (SELECT project, sha, log_pos, subject, date FROM v_commits UNION ALL SELECT project, sha, log_pos, subject, date FROM v_ecommits),
told AS (SELECT c.*, CAST(c.date AS DATE) AS day, n.sha IS NOT NULL AS narrated, n.what, s.why, n.decisions, coalesce(n.degraded, false) AS degraded,
    list_filter(n.risks, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '材料不足')) AS risks,
    list_filter(n.open_loops, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '材料不足')) AS loops
  FROM cm c LEFT JOIN v_narr n ON n.sha = c.sha AND n.project = c.project LEFT JOIN safe s ON s.doc_id = n.doc_id),
dg AS (SELECT project, day, count(*) AS commits, count(*) FILTER (WHERE narrated) AS hits,
    '今日 ' || count(*) || ' 个 commit:' || array_to_string(list_slice(list(subject ORDER BY log_pos), 1, 3), ';') AS overview,
    coalesce(arg_min(decisions[1], log_pos) FILTER (WHERE decisions[1] IS NOT NULL), '') AS decision FROM told GROUP BY 1, 2),
back AS (SELECT project, day, '上月今日' AS label, 0 AS part, CAST(day - INTERVAL 1 MONTH AS DATE) AS past_day FROM dg
  UNION ALL SELECT project, day, '去年今日', 1, CAST(day - INTERVAL 12 MONTH AS DATE) FROM dg),
caps AS (SELECT c.*, m.log_pos, m.subject FROM v_caps c JOIN dg ON dg.project = c.project AND dg.day = c.opened_date LEFT JOIN cm m ON m.sha = c.sha WHERE c.opened_date IS NOT NULL),
refs AS (SELECT project, sha, '关联会话:' || string_agg('`' || sid || '`(交集 ' || n || ' 文件)', '、' ORDER BY sid) AS line FROM (
  SELECT project, sha, substr(session_id, 1, 8) AS sid, arg_min(n_overlap, source || '|' || session_id) AS n FROM matches WHERE confidence = 'high' GROUP BY ALL) GROUP BY 1, 2),
loops AS (SELECT project, day, item, min(log_pos) AS log_pos FROM (SELECT project, day, log_pos, unnest(loops) AS item FROM told) GROUP BY ALL),
lines AS (
  SELECT project, day, 0 AS section, 0 AS log_pos, 0 AS part, '# ' || strftime(day, '%Y-%m-%d') || ' ' || split_part(project, '/', -1) || ' 开发日报' AS line FROM dg
  UNION ALL SELECT b.project, b.day, 1, 0, b.part, '> 📮 **' || label || '** · ' || strftime(past_day, '%Y-%m-%d') || ':「' || split_part(p.overview, '。', 1) || '。」'
    FROM back b JOIN dg p ON p.project = b.project AND p.day = b.past_day
  UNION ALL SELECT project, day, 2, 0, 1, '## 今日概览' FROM dg UNION ALL SELECT project, day, 2, 0, 2, overview FROM dg
  UNION ALL SELECT project, day, 2, 0, 3, '> **今日决定** — ' || decision FROM dg WHERE decision <> ''
  UNION ALL SELECT DISTINCT project, opened_date, 3, -1, 0, '## 🕰 今日开启的时间胶囊' FROM caps
  UNION ALL SELECT project, opened_date, 3, log_pos, 0, '<!-- vt-capsule:' || capsule_id || ' -->' FROM caps
  UNION ALL SELECT project, opened_date, 3, log_pos, 1, '- **' || (opened_date - sealed_date) || ' 天前**(`' || substr(sha, 1, 7) || '`)你担心:「' || risk || '」' ||
    chr(10) || chr(9) || '> 📌 `' || substr(sha, 1, 7) || '` ' || subject FROM caps
  UNION ALL SELECT project, opened_date, 3, log_pos, 2 + i, chr(9) || '- [' || CASE WHEN outcome = o THEN 'x' ELSE ' ' END || '] ' || o
    FROM caps, (SELECT unnest(['想多了', '已解决', '还在担心', '忘记了']) AS o, unnest(range(4)) AS i)
  UNION ALL SELECT project, day, 4, -1, 0, '## 变更叙事' FROM dg
  UNION ALL SELECT project, day, 4, log_pos, 0, '### `' || substr(sha, 1, 8) || '` ' || subject || '(' || strftime(date, '%H:%M') || ')' FROM told
  UNION ALL SELECT project, day, 4, log_pos, 1, '> ⚠️ 本条为降级叙事(LLM 调用失败)' FROM told WHERE degraded
  UNION ALL SELECT project, day, 4, log_pos, 2, '**改了什么** ' || what FROM told WHERE narrated
  UNION ALL SELECT project, day, 4, log_pos, 3, '**为什么** ' || why FROM told WHERE narrated
  UNION ALL SELECT project, day, 4, log_pos, 4, {_LIST.format('decisions', '关键决策')} FROM told
  UNION ALL SELECT project, day, 4, log_pos, 5, {_LIST.format('risks', '风险(供日后验证)')} FROM told
  UNION ALL SELECT project, day, 4, log_pos, 6, {_LIST.format('loops', '未闭环')} FROM told
  UNION ALL SELECT t.project, t.day, 4, t.log_pos, 99, r.line FROM told t JOIN refs r ON r.sha = t.sha AND r.project = t.project
  UNION ALL SELECT project, day, 5, -1, 0, '## 未闭环汇总' FROM dg
  UNION ALL SELECT project, day, 5, log_pos, 0, '- ' || item FROM loops
  UNION ALL SELECT project, day, 5, 0, 0, '(无)' FROM dg WHERE (project, day) NOT IN (SELECT (project, day) FROM loops)
  UNION ALL SELECT project, day, 6, 0, 0, '---' FROM dg
  UNION ALL SELECT dg.project, dg.day, 6, 0, 1, 'commits ' || commits || ' | 会话 ' || coalesce(s.n, 0) || ' | 缓存命中 ' || hits || '/' || commits || ' | LLM 调用 ' || (commits - hits)
    || CASE WHEN f.opened > 0 THEN ' | 胶囊回填 ' || f.filled || '/' || f.opened ELSE '' END
    FROM dg LEFT JOIN (SELECT project, CAST(started AS DATE) AS day, count(*) AS n FROM v_sess GROUP BY 1, 2) s ON s.project = dg.project AND s.day = dg.day
    LEFT JOIN (SELECT project, opened_date AS day, count(*) AS opened, count(outcome) AS filled FROM v_caps WHERE opened_date IS NOT NULL GROUP BY 1, 2) f ON f.project = dg.project AND f.day = dg.day)
SELECT project, strftime(day, '%Y-%m-%d') AS day, CAST(section AS BIGINT) AS section, CAST(log_pos AS BIGINT) AS log_pos, CAST(part AS BIGINT) AS part, md5(line) AS line
FROM lines WHERE line IS NOT NULL"""


@query("daily_report_document", REPORT_SQL)
def daily_report_document(t):
    """Every line of every daily report, in its place."""
    columns = ["project", "sha", "log_pos", "subject", "date"]
    both = t.commits().select(*columns).unionByName(t.event_commits().select(*columns))
    events = t.event_commits()
    matches = A.align(events, events, t.sessions(), t.session_files())
    rows = reports.report_document(both, t.narratives(), t.capsules(), t.sessions(), matches)
    return rows.select("project", F.col("day").cast("string").alias("day"), F.col("section").cast("bigint").alias("section"), "log_pos",
                       F.col("part").cast("bigint").alias("part"), F.md5("line").alias("line"))
