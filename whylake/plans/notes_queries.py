"""Queries on commits, notes, narratives, file and line history, and coverage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from whylake.functions import notes
from whylake.functions.text import bounded_text, commit_type, since_bound
from whylake.operators import coverage as C
from whylake.operators import history as H
from whylake.operators.ranking import among
from whylake.plans.history_queries import TODAY, TODAY_SQL
from whylake.plans.registry import query
from whylake.session import written

NOW = datetime(2001, 9, 1)


def joined(name):
    return F.array_join(F.coalesce(F.col(name), F.array().cast("array<string>")), " | ").alias(name)


def text_list(expr):
    """SQL: a list as text; NULL counts as empty."""
    return f"coalesce(array_to_string({expr}, ' | '), '')"


@query("src_commit_files", "SELECT project, sha, file FROM v_files")
def src_commit_files(t):
    return t.files().select("project", "sha", "file")


@query("filter_basic", "SELECT project, sha, subject FROM v_all WHERE NOT is_merge")
def filter_basic(t):
    return t.all_commits().filter(~F.col("is_merge")).select("project", "sha", "subject")


@query("since_filter", f"SELECT project, sha FROM v_commits WHERE date >= {TODAY_SQL} - 720")
def since_filter(t):
    return H.since(t.commits(), since_bound("24 months ago", NOW)).select("project", "sha")


@query("bounded_text", """
SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '... [diff 已截断]' ELSE text END) AS digest
FROM documents""")
def bounded(t):
    return t.raw("documents").select("doc_id", F.md5(bounded_text(F.col("text"), 2000)).alias("digest"))


@query("parse_notes", """
SELECT project, sha, item.kind AS kind, item.pos AS pos, item.text AS text FROM (
  SELECT project, sha, unnest(list_filter([
    {'kind': 'decision', 'pos': 0, 'text': dec}, {'kind': 'watch', 'pos': 0, 'text': watch},
    {'kind': 'rejected', 'pos': 0, 'text': rej}], lambda x: x.text IS NOT NULL)) AS item FROM v_commits)""")
def parse_notes(t):
    body = F.col("body")
    parsed = t.commits().select("project", "sha", F.explode(F.array(
        F.struct(F.lit("decision").alias("kind"), notes.decisions(body).alias("texts")),
        F.struct(F.lit("watch").alias("kind"), notes.watches(body).alias("texts")),
        F.struct(F.lit("rejected").alias("kind"), notes.rejected(body).alias("texts")))).alias("n"))
    return parsed.select("project", "sha", "n.kind", F.posexplode("n.texts").alias("pos", "text"))


@query("commit_narrative", """
SELECT c.project, c.sha, c.subject, n.what, len(n.decisions) AS n_decisions, n.sha IS NOT NULL AS narrated
FROM v_commits c LEFT JOIN v_narr n ON n.project = c.project AND n.sha = c.sha""")
def commit_narrative(t):
    return H.commit_narrative(t.commits(), t.narratives()).select(
        "project", "sha", "subject", "what",
        F.when(F.col("decisions").isNotNull(), F.size("decisions").cast("bigint")).alias("n_decisions"),
        F.col("what").isNotNull().alias("narrated"))



@query("merge_notes", f"""
SELECT c.project, c.sha,
  {text_list("CASE WHEN n.sha IS NULL THEN [c.dec] ELSE n.decisions END")} AS decisions,
  {text_list("CASE WHEN n.sha IS NULL THEN [c.watch] ELSE n.risks END")} AS risks,
  {text_list("CASE WHEN n.sha IS NULL THEN [c.rej] ELSE n.rejected END")} AS rejected
FROM v_commits c LEFT JOIN v_narr n ON n.sha = c.sha""")
def merge_notes(t):
    return H.merge_notes(t.commits(), t.narratives()).select(
        "project", "sha", joined("decisions"), joined("risks"), joined("rejected"))


SEGMENTS_SQL = f"""
SELECT c.project, c.sha, c.log_pos, c.subject, md5(coalesce(n.why, '')) AS why,
  {text_list("CASE WHEN n.sha IS NULL THEN [c.dec] ELSE n.decisions END")} AS decisions,
  {text_list("CASE WHEN n.sha IS NULL THEN [c.watch] ELSE n.risks END")} AS risks,
  {text_list("CASE WHEN n.sha IS NULL THEN [c.rej] ELSE n.rejected END")} AS rejected,
  coalesce(c.dec, '') AS authored_decisions, coalesce(c.rej, '') AS authored_rejected,
  {text_list("list_filter(n.decisions, lambda x: x <> coalesce(c.dec, ''))")} AS generated_decisions,
  {text_list("list_filter(n.rejected, lambda x: x <> coalesce(c.rej, ''))")} AS generated_rejected,
  coalesce(trim(n.why) <> '', false) OR c.dec IS NOT NULL OR c.rej IS NOT NULL OR coalesce(len(n.decisions), 0) > 0
    OR coalesce(len(n.rejected), 0) > 0 OR coalesce(n.n_evidence, 0) > 0 AS has_why
FROM v_commits c LEFT JOIN v_narr n ON n.sha = c.sha"""


@query("segments", SEGMENTS_SQL)
def segments(t):
    return H.segments(t.commits(), t.narratives()).select(
        "project", "sha", "log_pos", "subject", F.md5("why").alias("why"), joined("decisions"), joined("risks"),
        joined("rejected"), joined("authored_decisions"), joined("authored_rejected"), joined("generated_decisions"),
        joined("generated_rejected"), "has_why")


@query("timeline", f"""
SELECT c.project, substr(c.sha, 1, 7) AS sha7, c.log_pos, strftime(c.date, '%Y-%m-%d %H:%M') AS at,
  {TODAY_SQL} - CAST(c.date AS DATE) AS days_ago, c.subject, coalesce(substr(n.what, 1, 220), '') AS what,
  coalesce(substr(n.why, 1, 220), '') AS why, {text_list("list_slice(n.decisions, 1, 6)")} AS decisions,
  {text_list("list_slice(list_concat(n.risks, n.open_loops), 1, 5)")} AS risks,
  coalesce(k.capsule_id || '=' || coalesce(k.outcome, ''), '') AS capsules
FROM v_commits c LEFT JOIN v_narr n ON n.sha = c.sha LEFT JOIN v_caps k ON k.sha = c.sha""")
def timeline(t):
    rows = H.timeline(t.commits(), t.narratives(), t.capsules(), TODAY)
    caps = F.transform(F.col("capsules"), lambda c: F.concat(c["capsule_id"], F.lit("="), F.coalesce(c["outcome"], F.lit(""))))
    return rows.select(
        "project", "sha7", "log_pos", "at", F.col("days_ago").cast("bigint").alias("days_ago"), "subject", "what", "why",
        joined("decisions"), joined("risks"), F.coalesce(F.array_join(caps, ","), F.lit("")).alias("capsules"))


@query("prior_commit", """
SELECT project, sha, arg_max(prev, prev_pos) AS prior_sha FROM (
  SELECT *, lag(sha) OVER w AS prev, lag(log_pos) OVER w AS prev_pos FROM v_files
  WINDOW w AS (PARTITION BY project, file ORDER BY log_pos)) GROUP BY ALL""")
def prior_commit(t):
    return H.prior_commit(t.files())


@query("trivial_commits", """
SELECT project, sha, count(*) AS n_files FROM v_files GROUP BY ALL HAVING bool_and(file LIKE '%.lock')""")
def trivial_commits(t):
    return H.trivial_commits(t.files())


NEWEST_FILES = "SELECT project, file FROM (SELECT *, max(log_pos) OVER (PARTITION BY project) AS newest FROM v_files) WHERE log_pos = newest"


def changed_files(t):
    """The files of each project's newest commit play the changed files of its working copy."""
    newest = t.files().groupBy("project").agg(F.max("log_pos").alias("log_pos"))
    return t.files().join(newest, ["project", "log_pos"], "left_semi").select("project", "file")


@query("file_grounding", f"""
SELECT f.project, f.file, substr(f.sha, 1, 7) AS sha7, f.log_pos, c.subject, strftime(c.date, '%Y-%m-%d') AS day,
  {text_list("n.decisions")} AS decisions
FROM v_files f JOIN ({NEWEST_FILES}) g ON g.project = f.project AND g.file = f.file JOIN v_commits c ON c.sha = f.sha
LEFT JOIN v_narr n ON n.sha = f.sha""")
def file_grounding(t):
    return H.file_grounding(changed_files(t), t.files(), t.commits(), t.narratives()).withColumn("decisions", joined("decisions"))


@query("changelog", """
SELECT project, substr(sha, 1, 8) AS sha8, strftime(date, '%Y-%m-%d') AS day, subject, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY log_pos DESC) AS rank FROM v_commits) WHERE rank <= 20""")
def changelog(t):
    return H.changelog(t.commits()).select(
        "project", F.substring("sha", 1, 8).alias("sha8"), F.date_format("date", "yyyy-MM-dd").alias("day"), "subject",
        F.col("rank").cast("bigint").alias("rank"))


@query("file_history", """
SELECT project, file AS path, sha, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project, file ORDER BY log_pos DESC) AS rank FROM v_files) WHERE rank <= 50""")
def file_history(t):
    return H.file_history(t.files()).select("project", "path", "sha", F.col("rank").cast("bigint").alias("rank"))


# Hunks of each project's newest commits play the pending diff.
PENDING_SQL = """SELECT DISTINCT h.project || '|' || h.file || '|' || h.sha || '|' || h.new_start || '|' || h.new_count AS target_id, h.project, h.file,
  h.new_start AS start, h.new_start + h.new_count - 1 AS "end", h.log_pos AS own_pos
  FROM v_hunks h JOIN (SELECT project, max(log_pos) AS newest FROM v_files GROUP BY 1) m
    ON m.project = h.project AND m.newest = h.log_pos"""


def pending_hunks(t):
    place = ["project", "log_pos"]
    newest = written(t.files().groupBy("project").agg(F.max("log_pos").alias("log_pos")))
    rows = among(t.hunks(), place, newest)
    return rows.select(
        F.concat_ws("|", "project", "file", "sha", "new_start", "new_count").alias("target_id"), "project", "file",
        F.col("new_start").alias("start"), (F.col("new_start") + F.col("new_count") - 1).alias("end"),
        F.col("log_pos").alias("own_pos")).distinct()


@query("line_overlap", f"""
SELECT DISTINCT t.target_id, h.sha, h.new_start FROM ({PENDING_SQL}) t JOIN v_hunks h ON h.project = t.project AND h.file = t.file
  AND h.new_start <= t."end" AND h.new_start + h.new_count - 1 >= t.start AND h.log_pos < t.own_pos""")
def line_overlap(t):
    met = H.line_overlap(pending_hunks(t), t.hunks()).filter("hit_pos < own_pos")
    return met.select("target_id", F.col("hit_sha").alias("sha"), "new_start").distinct()


# Tests of tracked sources, with invented bodies naming the file.
SNAPSHOT_SQL = """
SELECT project, 'tests/test_' || split_part(file, '/', 3) AS path, split_part(split_part(file, '/', 3), '.', 1) AS stem
FROM v_tracked WHERE file LIKE 'src/%'
UNION ALL SELECT project, file, split_part(split_part(file, '/', 2), '.', 1) FROM v_tracked WHERE file LIKE 'tests/%'"""


def snapshot(t):
    """(project, path, text) of test files, one per tracked source or test."""
    rows = t.tracked().filter("file LIKE 'src/%' OR file LIKE 'tests/%'").selectExpr(
        "project", "CASE WHEN file LIKE 'src/%' THEN concat('tests/test_', split_part(file, '/', 3)) ELSE file END AS path",
        "split_part(split_part(file, '/', -1), '.', 1) AS stem")
    return rows.selectExpr(
        "project", "path", r"concat('import x\n\ndef test_', stem, '_ok():\n    pass\n\nasync def test_', stem, '_slow():\n    pass\n"
        r"\ndef helper():\n    pass\n') AS text")


@query("test_refs_topn", f"""
SELECT project, sha, path, names, rank FROM (
  SELECT w.project, w.sha, w.path, 'test_' || s.stem || '_ok,test_' || s.stem || '_slow' AS names,
    row_number() OVER (PARTITION BY w.sha ORDER BY w.path) AS rank
  FROM (SELECT DISTINCT project, sha, CASE WHEN split_part(file, '/', -1) LIKE 'test\\_%' ESCAPE '\\' THEN file
          ELSE 'tests/test_' || split_part(file, '/', -1) END AS path FROM v_files WHERE file LIKE '%.py') w
  JOIN ({SNAPSHOT_SQL}) s ON s.project = w.project AND s.path = w.path) WHERE rank <= 5""")
def test_refs_topn(t):
    return H.test_refs(t.files(), snapshot(t)).select(
        "project", "sha", "path", F.array_join("names", ",").alias("names"), F.col("rank").cast("bigint").alias("rank"))


@query("best_file", """
SELECT project, file, touches, grounded FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY kind, is_test, grounded DESC, touches DESC, file) AS r FROM (
    SELECT f.project, f.file, count(*) AS touches,
      count(*) FILTER (WHERE c.dec IS NOT NULL OR c.watch IS NOT NULL OR c.rej IS NOT NULL) AS grounded,
      CASE WHEN f.file LIKE '%.py' THEN 0 WHEN f.file LIKE '%.md' THEN 5 ELSE 99 END AS kind,
      f.file LIKE 'tests/%' OR f.file LIKE '%/test%' AS is_test
    FROM v_files f JOIN v_commits c ON c.sha = f.sha JOIN v_tracked t ON t.project = f.project AND t.file = f.file GROUP BY ALL))
WHERE r = 1""")
def best_file(t):
    noted = t.commits().filter(notes.has_notes(F.col("body")))
    return H.best_file(t.files(), noted, t.tracked())


@query("dir_rollup", """
SELECT node, max(d < n) AS is_dir, bool_or(changed) AS changed, count(*) AS files FROM (
  SELECT changed, d, len(parts) AS n, array_to_string(list_slice(parts, 1, d), '/') AS node FROM (
    SELECT changed, parts, unnest(range(1, len(parts) + 1)) AS d FROM (
      SELECT url LIKE '%?%' AS changed, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM v_url_paths)))
GROUP BY node""")
def dir_rollup(t):
    return H.dir_rollup(t.url_paths().select("path", F.contains("url", F.lit("?")).alias("changed")))


ROOTS_SQL = """SELECT DISTINCT '/' || host AS root FROM v_url_paths WHERE host LIKE 'blog.%'
  UNION SELECT DISTINCT '/' || host || '/en' FROM v_url_paths UNION SELECT path FROM v_url_paths WHERE path LIKE '%.html'"""


@query("attribute_prefix", f"""
WITH roots AS ({ROOTS_SQL}), exact AS (SELECT page_id AS item, root, 'exact' AS how FROM v_url_paths JOIN roots ON root = path)
SELECT * FROM exact UNION ALL SELECT DISTINCT page_id, root, 'below' FROM v_url_paths JOIN roots
  ON path = root OR starts_with(path, root || '/') WHERE root NOT IN (SELECT root FROM exact)""")
def attribute_prefix(t):
    p = t.url_paths()
    roots = (
        p.filter("host LIKE 'blog.%'").selectExpr("concat('/', host) AS root")
        .union(p.selectExpr("concat('/', host, '/en') AS root")).union(p.filter("path LIKE '%.html'").selectExpr("path AS root"))
        .distinct())
    return H.attribute(p.select(F.col("page_id").alias("item"), "path"), roots)


CHAPTERS_SQL = """
WITH placed AS (
  SELECT *, (pos - 1) // CAST(ceil(n / greatest(1.0, round(sqrt(n)))) AS BIGINT) + 1 AS chapter FROM (
    SELECT *, row_number() OVER (PARTITION BY project ORDER BY log_pos) AS pos, count(*) OVER (PARTITION BY project) AS n
    FROM v_commits))
"""


@query("chapters", CHAPTERS_SQL + """
SELECT p.project, p.chapter, '第 ' || p.chapter || ' 阶段:' || substr(arg_min(p.subject, p.log_pos), 1, 40) AS title,
  md5(coalesce(arg_min(n.why, p.log_pos) FILTER (WHERE trim(n.why) <> ''), '(未智能编排)')) AS intro, count(*) AS commits,
  arg_min(p.sha, p.log_pos) AS first_sha, arg_max(p.sha, p.log_pos) AS last_sha
FROM placed p LEFT JOIN v_narr n ON n.sha = p.sha GROUP BY 1, 2""")
def chapters(t):
    return H.chapter_summaries(H.chapters(t.commits()), t.narratives()).withColumn("intro", F.md5("intro"))


@query("chapter_blocks", CHAPTERS_SQL + """
SELECT q.project, q.chapter, q.rank, substr(q.sha, 1, 7) AS sha7, q.subject, CASE split_part(q.subject, ':', 1)
  WHEN 'fix' THEN 'fix' WHEN 'feat(core)' THEN 'feat' WHEN 'refactor' THEN 'refactor' WHEN 'chore' THEN 'chore' ELSE '' END AS kind,
  coalesce(substr(n.what, 1, 220), '') AS what
FROM (SELECT *, row_number() OVER (PARTITION BY project, chapter ORDER BY log_pos) AS rank FROM placed) q
LEFT JOIN v_narr n ON n.sha = q.sha WHERE rank <= 2""")
def chapter_blocks(t):
    return H.chapter_blocks(H.chapters(t.commits()), t.narratives()).select(
        "project", F.col("chapter").cast("bigint").alias("chapter"), F.col("rank").cast("bigint").alias("rank"),
        F.substring("sha", 1, 7).alias("sha7"), "subject", commit_type(F.col("subject")).alias("kind"),
        F.coalesce("what", F.lit("")).alias("what"))


@query("commit_type", """
SELECT sha, CASE split_part(subject, ':', 1) WHEN 'fix' THEN 'fix' WHEN 'feat(core)' THEN 'feat' WHEN 'refactor' THEN 'refactor'
  WHEN 'chore' THEN 'chore' ELSE '' END AS kind FROM v_all""")
def commit_type_query(t):
    return t.all_commits().select("sha", commit_type(F.col("subject")).alias("kind"))


HIT_SQL = """
SELECT *, round(100.0 * real_grounded / total, 1) AS real_pct, round(100.0 * evidence / total, 1) AS depth_pct FROM (
  SELECT c.project, count(*) AS total, count(n.sha) AS narrated,
    count(*) FILTER (WHERE coalesce(c.dec, c.watch, c.rej) IS NOT NULL) AS noted,
    count(*) FILTER (WHERE n.n_evidence > 0) AS evidence,
    count(*) FILTER (WHERE coalesce(c.dec, c.watch, c.rej) IS NOT NULL OR n.n_evidence > 0) AS real_grounded,
    count(*) FILTER (WHERE coalesce(c.dec, c.watch, c.rej) IS NOT NULL OR n.n_evidence > 0 OR trim(n.why) <> ''
                     OR len(n.decisions) > 0) AS grounded
  FROM v_commits c LEFT JOIN v_narr n ON n.sha = c.sha GROUP BY 1)"""


@query("coverage_hitrate", "SELECT * EXCLUDE (real_pct, depth_pct) FROM (" + HIT_SQL + ")")
def coverage_hitrate(t):
    return C.hit_rate(t.commits(), t.narratives()).drop("real_pct", "depth_pct", "coverage_pct", "narrated_pct")


# Commits with a test beside them.
TESTED_SQL = f"""SELECT DISTINCT f.sha FROM v_files f JOIN ({SNAPSHOT_SQL}) s ON s.project = f.project AND (s.path = f.file OR
  (s.path = 'tests/test_' || split_part(f.file, '/', -1) AND split_part(f.file, '/', -1) NOT LIKE 'test%')) WHERE f.file LIKE '%.py'"""


@query("coverage_sources", f"""
SELECT project, total, quotes, tests, prs, notes, grounded, total - grounded AS at_risk, grounded * 100 // total AS pct FROM (
SELECT c.project, count(*) AS total, count(n.sha) AS quotes, count(t.sha) AS tests, count(r.sha) AS prs, count(*) FILTER (WHERE c.dec IS NOT NULL OR
  c.watch IS NOT NULL) AS notes, count(*) FILTER (WHERE n.sha IS NOT NULL OR t.sha IS NOT NULL OR r.sha IS NOT NULL OR c.dec IS NOT NULL OR
  c.watch IS NOT NULL) AS grounded
FROM v_commits c LEFT JOIN v_requests r ON r.sha = c.sha LEFT JOIN (SELECT sha FROM v_narr WHERE n_evidence > 0) n ON n.sha = c.sha
LEFT JOIN ({TESTED_SQL}) t
  ON t.sha = c.sha GROUP BY 1)""")
def coverage_sources(t):
    quoted = t.narratives().filter("n_evidence > 0")
    tested = H.test_refs(t.files(), snapshot(t))
    return C.source_totals(C.by_source(t.commits(), quoted, tested, t.requests()))


@query("note_stats", """
SELECT *, CASE WHEN pct >= 25 THEN 'rich' WHEN rich > 0 THEN 'partial' ELSE 'cold-start' END AS tier FROM (
  SELECT project, count(*) AS total, count(*) FILTER (WHERE coalesce(dec, watch, rej) IS NOT NULL) AS rich,
    count(dec) AS decisions, count(watch) AS watches, count(rej) AS rejected,
    CAST(round_even(count(*) FILTER (WHERE coalesce(dec, watch, rej) IS NOT NULL) / count(*) * 100, 0) AS BIGINT) AS pct
  FROM v_commits GROUP BY project)""")
def note_stats(t):
    return C.note_stats(t.commits())


@query("coverage_last20", """
SELECT project, count(*) FILTER (WHERE coalesce(dec, watch, rej) IS NOT NULL) AS got, count(*) AS total,
  CAST(round_even(count(*) FILTER (WHERE coalesce(dec, watch, rej) IS NOT NULL) / count(*) * 100, 0) AS BIGINT) AS pct
FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY log_pos DESC) AS r FROM v_commits) WHERE r <= 20 GROUP BY 1""")
def coverage_last20(t):
    return C.last_n(t.commits())


@query("coverage_gap", """
SELECT project, total, narrated, total - narrated AS missing FROM (
  SELECT c.project, count(*) AS total, count(n.sha) AS narrated FROM v_commits c LEFT JOIN v_narr n ON n.sha = c.sha GROUP BY 1)
WHERE total > narrated""")
def coverage_gap(t):
    return C.narrative_gap(t.commits(), t.narratives()).drop("pct")


# A range is carried back commit by commit: the state of the fold over a commit's edits has the fields of an edit, so that
# one list can hold both.
_STATE = "'touched': {t}, 's1': {s1}, 's2': {s2}, 'f': {f}, 'l': {l}, 'st': {st}, 'en': {en}, 'a': {a}, 'n': {n}, 'o': {o}, 'm': {m}"
_ZERO = "CAST(0 AS BIGINT)"
_EDIT = "{" + _STATE.format(t="false", s1=_ZERO, s2=_ZERO, f=_ZERO, l=_ZERO, st=_ZERO, en=_ZERO, a="new_start", n="new_count", o="old_start", m="old_count") + "}"
_BEGIN = "{" + _STATE.format(t="false", s1=_ZERO, s2=_ZERO, f="w.f", l="w.l", st="w.f", en="w.l", a=_ZERO, n=_ZERO, o=_ZERO, m=_ZERO) + "}"
_STEP = "{" + _STATE.format(
    t="x.touched OR CASE WHEN e.n = 0 THEN e.a < x.en AND e.a >= x.st WHEN e.a + e.n - 1 < x.st THEN false ELSE e.a <= x.en END",
    s1=f"x.s1 + CASE WHEN e.n = 0 THEN CASE WHEN e.a < x.st THEN e.m ELSE {_ZERO} END WHEN e.a + e.n - 1 < x.st THEN e.m - e.n ELSE {_ZERO} END",
    s2=f"x.s2 + CASE WHEN e.n = 0 THEN CASE WHEN e.a < x.en THEN e.m ELSE {_ZERO} END WHEN e.a + e.n - 1 < x.st THEN e.m - e.n "
       f"WHEN e.a <= x.en AND e.a + e.n - 1 < x.en THEN e.m - e.n ELSE {_ZERO} END",
    f="CASE WHEN e.n > 0 AND e.a <= x.st AND x.st <= e.a + e.n - 1 THEN CASE WHEN e.m > 0 THEN e.o ELSE e.o + 1 END - x.s1 ELSE x.f END",
    l="CASE WHEN e.n > 0 AND e.a <= x.en AND x.en <= e.a + e.n - 1 THEN CASE WHEN e.m > 0 THEN e.o + e.m - 1 ELSE e.o END - x.s2 ELSE x.l END",
    st="x.st", en="x.en", a="x.a", n="x.n", o="x.o", m="x.m") + "}"


def line_walk(targets: str, hunks: str = "v_hunks") -> str:
    """CTEs ``trail`` (target_id, sha, log_pos): line history of ``targets`` (target_id, project, file, start, end,
    own_pos); the query has to begin WITH RECURSIVE."""
    return f"""walk_targets AS ({targets}),
walk_commits AS (SELECT project, file, sha, log_pos, list({_EDIT} ORDER BY new_start, new_count, old_start, old_count) AS edits FROM {hunks} SEMI JOIN walk_targets USING (project, file) GROUP BY ALL),
walk_steps AS (SELECT t.target_id, c.sha, c.log_pos, c.edits, row_number() OVER (PARTITION BY t.target_id ORDER BY c.log_pos DESC) AS k
  FROM walk_targets t JOIN walk_commits c ON c.project = t.project AND c.file = t.file AND (t.own_pos IS NULL OR c.log_pos < t.own_pos)),
walk AS (
  SELECT target_id, CAST(0 AS BIGINT) AS k, CAST(start AS BIGINT) AS f, CAST("end" AS BIGINT) AS l, CAST(0 AS BIGINT) AS hits, CAST(NULL AS VARCHAR) AS sha,
    CAST(NULL AS BIGINT) AS log_pos, false AS touched FROM walk_targets
  UNION ALL
  SELECT target_id, k, r.f + r.s1, r.l + r.s2, hits + CASE WHEN r.touched THEN 1 ELSE 0 END, sha, log_pos, r.touched FROM (
    SELECT w.target_id, s.k, w.hits, s.sha, s.log_pos, list_reduce(list_prepend({_BEGIN}, s.edits), lambda x, e: {_STEP}) AS r
    FROM walk w JOIN walk_steps s ON s.target_id = w.target_id AND s.k = w.k + 1 WHERE w.l >= w.f AND w.hits < 50)),
trail AS (SELECT target_id, sha, log_pos FROM walk WHERE touched)"""


@query("line_history", "WITH RECURSIVE " + line_walk(PENDING_SQL) + " SELECT target_id, sha, log_pos FROM trail")
def line_history(t):
    return H.line_history(pending_hunks(t), t.hunks()).select("target_id", "sha", "log_pos")


# Every rename with the name that its file has in the end; the last name of a file called so at a place is the one of the
# first rename of that name from there on.
LAST_NAMES_SQL = """rename_next AS (
  SELECT e.project, e.old, e.log_pos, e.new, min(f.log_pos) AS nxt FROM v_renames e LEFT JOIN v_renames f
    ON f.project = e.project AND f.old = e.new AND f.log_pos > e.log_pos GROUP BY ALL),
rename_chain AS (
  SELECT project, old AS name, log_pos AS place, new AS last, nxt FROM rename_next
  UNION ALL
  SELECT c.project, c.name, c.place, e.new, e.nxt FROM rename_chain c JOIN rename_next e ON e.project = c.project AND e.old = c.last AND e.log_pos = c.nxt),
last_names AS (SELECT project, name, place, last FROM rename_chain WHERE nxt IS NULL),
moved_hunks AS (SELECT h.* REPLACE (coalesce(x.last, h.file) AS file), h.file AS old_file FROM v_hunks h LEFT JOIN (
  SELECT h.project, h.file, h.log_pos, arg_min(l.last, l.place) AS last FROM (SELECT DISTINCT project, file, log_pos FROM v_hunks) h JOIN last_names l
    ON l.project = h.project AND l.name = h.file AND l.place >= h.log_pos GROUP BY ALL) x ON x.project = h.project AND x.file = h.file AND x.log_pos = h.log_pos)"""


@query("line_history_renames", f"""
WITH RECURSIVE {LAST_NAMES_SQL}, {line_walk(f"SELECT t.* REPLACE (coalesce(x.last, t.file) AS file) FROM ({PENDING_SQL}) t ASOF LEFT JOIN last_names x ON t.project = x.project AND t.file = x.name AND t.own_pos <= x.place", "moved_hunks")}
SELECT target_id, sha, log_pos FROM trail""")
def line_history_renames(t):
    return H.line_history(pending_hunks(t), t.hunks(), renames=t.renames()).select("target_id", "sha", "log_pos")


@query("file_history_renames", f"""
WITH RECURSIVE {LAST_NAMES_SQL}, named AS (SELECT DISTINCT f.project, coalesce(x.last, f.file) AS path, f.sha, f.log_pos FROM v_files f ASOF LEFT JOIN last_names x
  ON f.project = x.project AND f.file = x.name AND f.log_pos <= x.place)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY log_pos DESC) AS rank FROM named) WHERE rank <= 50""")
def file_history_renames(t):
    return H.file_history(t.files(), t.renames()).withColumn("rank", F.col("rank").cast("bigint"))


LINE_TARGETS_SQL = """SELECT DISTINCT h.project || '|' || h.file || '|' || h.new_start AS target_id, h.project, h.file, h.new_start AS line
  FROM v_hunks h JOIN v_tracked t ON t.project = h.project AND t.file = h.file"""


def line_targets(t):
    lines = t.hunks().join(t.tracked(), ["project", "file"], "left_semi").select("project", "file", "new_start").distinct()
    return lines.select(
        F.concat_ws("|", "project", "file", "new_start").alias("target_id"), "project", "file",
        F.col("new_start").alias("start"), F.col("new_start").alias("end"))


@query("line_recall", f"""
WITH RECURSIVE seg AS ({SEGMENTS_SQL}), {line_walk('SELECT *, line AS start, line AS "end", CAST(NULL AS BIGINT) AS own_pos FROM (' + LINE_TARGETS_SQL + ')')},
judged AS (SELECT h.target_id, bool_or(s.has_why) AS wnd, arg_max(s.has_why, h.log_pos) AS strict
  FROM trail h JOIN seg s ON s.sha = h.sha GROUP BY 1)
SELECT t.project, count(*) AS sampled, count(*) FILTER (WHERE j.wnd) AS "window", count(*) FILTER (WHERE j.strict) AS strict,
  count(*) FILTER (WHERE j.wnd IS NULL) AS no_history FROM ({LINE_TARGETS_SQL}) t LEFT JOIN judged j USING (target_id) GROUP BY 1""")
def line_recall(t):
    explained = H.segments(t.commits(), t.narratives()).select("project", "sha", "log_pos", "has_why")
    return C.line_recall(line_targets(t), t.hunks(), explained)


@query("sample_lines", f"""
SELECT project || '/' || file AS path, line FROM ({LINE_TARGETS_SQL}) ORDER BY md5(project || '/' || file || ':' || line || ':1729'), 1, 2 LIMIT 200""")
def sample_lines(t):
    lines = line_targets(t).select(F.concat_ws("/", "project", "file").alias("path"), F.col("start").alias("line"))
    return C.sample_lines(lines, 200)


@query("filler_filter", f"""
SELECT project, sha, {text_list("list_filter(risks, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '材料不足'))")} AS risks,
  {text_list("list_filter(open_loops, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '材料不足'))")} AS open_loops FROM v_narr""")
def filler_filter(t):
    return t.narratives().select(
        "project", "sha", F.array_join(notes.without_filler(F.col("risks")), " | ").alias("risks"),
        F.array_join(notes.without_filler(F.col("open_loops")), " | ").alias("open_loops"))
