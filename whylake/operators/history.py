"""Commit history joined with narratives and notes; file and line history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions import notes
from whylake.functions.text import is_trivial_name
from whylake.operators import linemaps
from whylake.operators.ranking import first_texts, positions, previous, sieved, top_n
from whylake.session import cut_lineage, written

COMMIT = ["project", "sha"]


def since(commits: DataFrame, bound) -> DataFrame:
    """Commits from ``bound`` on; no bound keeps everything."""
    return commits if bound is None else commits.filter(F.col("date") >= F.lit(bound))


def revision_range(commits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Commits after ``from_sha`` up to and including ``to_sha``; one range per project."""
    at = commits.select("project", "sha", "log_pos")
    low = ranges.join(at.withColumnRenamed("sha", "from_sha").withColumnRenamed("log_pos", "_low"), ["project", "from_sha"])
    both = low.join(at.withColumnRenamed("sha", "to_sha").withColumnRenamed("log_pos", "_high"), ["project", "to_sha"])
    return commits.join(both.select("project", "_low", "_high"), "project").filter(
        "log_pos > _low AND log_pos <= _high").drop("_low", "_high")


def commit_narrative(commits: DataFrame, narratives: DataFrame) -> DataFrame:
    return commits.join(narratives.drop("log_pos", "date"), COMMIT, "left")


def merge_notes(commits: DataFrame, narratives: DataFrame) -> DataFrame:
    """Narrative items and the commit's own notes as one list each, narrative first, no repeats."""
    joined = commits.join(narratives.select(*COMMIT, "decisions", "risks", "rejected"), COMMIT, "left")
    body = F.col("body")
    return joined.select(
        *COMMIT,
        notes.merged(F.col("decisions"), notes.decisions(body)).alias("decisions"),
        notes.merged(F.col("risks"), notes.watches(body)).alias("risks"),
        notes.merged(F.col("rejected"), notes.rejected(body)).alias("rejected"),
    )


def references(tests: DataFrame, requests: DataFrame, limit: int = K.REFERENCE_LIMIT) -> DataFrame:
    """Checkable sources of a commit besides its evidence: tests (project, sha, path, names) and pull requests
    (project, sha, number, title), at most ``limit`` of each kind, as arrays; ``n_refs`` counts all."""
    listed = []
    said = ["number", "title", *(["snippet"] if "snippet" in requests.columns else [])]
    for name, known, columns in (("test_refs", tests, ["path", "names"]), ("pr_refs", requests, said)):
        first = top_n(known.select(*COMMIT, *columns), COMMIT, [F.col(columns[0])], limit, "_place")
        listed.append(first.groupBy(*COMMIT).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)))
    totals = tests.select(*COMMIT).unionByName(requests.select(*COMMIT)).groupBy(*COMMIT).agg(F.count(F.lit(1)).alias("n_refs"))
    return totals.join(listed[0], COMMIT, "left").join(listed[1], COMMIT, "left")


def stored_references(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """What is stored behind commits for a reader to check: ``references`` and evidence records (project, sha, evidence),
    as arrays that are empty where a kind is missing."""
    both = refs.select(*COMMIT, "test_refs", "pr_refs").join(evidence.select(*COMMIT, "evidence"), COMMIT, "full")
    fields = {f.name: f.dataType for f in both.schema.fields}
    return both.select(*COMMIT, *(F.coalesce(c, F.array().cast(fields[c])).alias(c) for c in ("evidence", "test_refs", "pr_refs")))


def segments(commits: DataFrame, narratives: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """What is known about each commit, with authored records and generated text kept apart; ``refs`` from
    ``references`` adds its tests and requests."""
    joined = commits.join(
        narratives.select(*COMMIT, "why", "decisions", "risks", "rejected", "n_evidence"), COMMIT, "left")
    if refs is not None:
        joined = joined.join(refs, COMMIT, "left")
    extra = [] if refs is None else ["test_refs", "pr_refs", F.coalesce("n_refs", F.lit(0)).alias("n_refs")]
    body = F.col("body")
    parsed = joined.withColumns({
        "authored_decisions": notes.decisions(body), "authored_rejected": notes.rejected(body),
        "_watches": notes.watches(body),
        "_dec": notes.texts_or_empty(F.col("decisions")), "_rej": notes.texts_or_empty(F.col("rejected")),
    })
    shaped = parsed.select(
        *COMMIT, "log_pos", "date", "subject", F.coalesce("why", F.lit("")).alias("why"),
        notes.merged(F.col("_dec"), F.col("authored_decisions")).alias("decisions"),
        notes.merged(F.col("risks"), F.col("_watches")).alias("risks"),
        notes.merged(F.col("_rej"), F.col("authored_rejected")).alias("rejected"),
        "authored_decisions", "authored_rejected",
        F.array_except("_dec", "authored_decisions").alias("generated_decisions"),
        F.array_except("_rej", "authored_rejected").alias("generated_rejected"),
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), *extra,
    )
    return shaped.withColumn(
        "has_why", notes.has_why(F.col("why"), F.col("decisions"), F.col("rejected"), F.col("n_evidence")))


def timeline(commits: DataFrame, narratives: DataFrame, capsules: DataFrame, today) -> DataFrame:
    """History rows for reading from the newest back; order by ``log_pos`` descending."""
    caps = capsules.groupBy(*COMMIT).agg(
        F.array_sort(F.collect_list(F.struct("capsule_id", "risk", "outcome", F.col("opened_date").isNotNull().alias("opened"))))
        .alias("capsules"))
    joined = commit_narrative(commits, narratives).join(caps, COMMIT, "left")
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, K.TIMELINE_EXCERPT)
    lists = notes.texts_or_empty
    return joined.select(
        "project", F.substring("sha", 1, 7).alias("sha7"), "log_pos", F.date_format("date", "yyyy-MM-dd HH:mm").alias("at"),
        F.datediff(F.lit(today), F.col("date")).alias("days_ago"), "subject", cut("what").alias("what"), cut("why").alias("why"),
        F.slice(lists(F.col("decisions")), 1, 6).alias("decisions"),
        F.slice(F.concat(lists(F.col("risks")), lists(F.col("open_loops"))), 1, 5).alias("risks"), "capsules",
    )


def prior_commit(files: DataFrame) -> DataFrame:
    """For every commit the newest earlier commit that touched one of its files.

    Files meet by positions only, which name the commits of a project; SHAs, wide and as many as files, come in once for
    each commit.
    """
    places = files.select("project", "file", "log_pos", F.to_date("date").alias("_day"))
    looked = previous(places, ["project", "file"], F.col("_day"), "log_pos", None, "prior")
    newest = looked.groupBy("project", "log_pos").agg(F.max("prior_order").alias("prior_pos"))
    names = files.select("project", "log_pos", "sha").distinct()
    before = names.select("project", F.col("log_pos").alias("prior_pos"), F.col("sha").alias("prior_sha"))
    own = newest.join(names, ["project", "log_pos"]).groupBy("project", "sha").agg(F.max("prior_pos").alias("prior_pos"))
    return own.join(before, ["project", "prior_pos"], "left").select("project", "sha", "prior_sha")


def prior_context(files: DataFrame, narratives: DataFrame) -> DataFrame:
    prior = prior_commit(files).filter("prior_sha IS NOT NULL")
    what = narratives.select("project", F.col("sha").alias("prior_sha"), F.substring("what", 1, 200).alias("prior_what"))
    return prior.join(what, ["project", "prior_sha"]).filter("prior_what <> ''").select("project", "sha", "prior_sha", "prior_what")


def trivial_commits(files: DataFrame) -> DataFrame:
    """Commits that touch only lock files and generated bundles."""
    return files.groupBy(*COMMIT).agg(F.bool_and(is_trivial_name(F.col("file"))).alias("_t"), F.count(F.lit(1)).alias("n_files")).filter(
        "_t").drop("_t")


def file_grounding(changed: DataFrame, files: DataFrame, commits: DataFrame, narratives: DataFrame) -> DataFrame:
    """History rows of the changed files only; order by ``log_pos`` descending per file."""
    hit = files.join(changed.select("project", "file"), ["project", "file"], "left_semi")
    rows = hit.select(*COMMIT, "file", "log_pos").join(commits.select(*COMMIT, "date", "subject"), COMMIT)
    return rows.join(narratives.select(*COMMIT, "decisions"), COMMIT, "left").select(
        "project", "file", F.substring("sha", 1, 7).alias("sha7"), "log_pos", "subject",
        F.date_format("date", "yyyy-MM-dd").alias("day"), notes.texts_or_empty(F.col("decisions")).alias("decisions"))


def changelog(commits: DataFrame, n: int = 20) -> DataFrame:
    return top_n(commits, ["project"], [F.col("log_pos").desc()], n)


# --- renames and file history ---------------------------------------------------

def rename_events(renames: DataFrame) -> DataFrame:
    """Resolve chains of renames (project, log_pos, old, new) to the last name, following each name only forward in
    time.  Pointer doubling: a chain of n renames needs log2(n) rounds; lineage is cut every round.  One event per
    (project, old, log_pos) is assumed."""
    events = renames.select("project", F.col("old").alias("name"), F.col("log_pos").alias("at"), F.col("new").alias("last"),
                            F.col("log_pos").alias("last_at"))
    step = cut_lineage(events)
    while True:
        later = step.select("project", F.col("name").alias("last"), F.col("at").alias("_at"), F.col("last").alias("_last"),
                            F.col("last_at").alias("_last_at"))
        # the first event of the current last name after the place reached so far
        nexts = step.join(later, ["project", "last"]).filter("_at > last_at").groupBy("project", "name", "at").agg(
            F.min_by(F.struct("_last", "_last_at"), "_at").alias("_n"))
        moved = step.join(nexts, ["project", "name", "at"], "left")
        changed = moved.filter("_n IS NOT NULL").limit(1).count()
        if not changed:
            return step
        step = cut_lineage(moved.select(
            "project", "name", "at", F.coalesce(F.col("_n._last"), F.col("last")).alias("last"),
            F.coalesce(F.col("_n._last_at"), F.col("last_at")).alias("last_at")))


def canonical_files(files: DataFrame, renames: DataFrame | None) -> DataFrame:
    """Add ``path``, the present name of the touched file."""
    if renames is None:
        return files.withColumn("path", F.col("file"))
    return _last_names(files.withColumn("_at", F.col("log_pos")), rename_events(renames)).drop("_at")


def _last_names(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``path``, the last name of the file that was called ``file`` at ``_at``."""
    listed = events.groupBy("project", F.col("name").alias("file")).agg(F.array_sort(F.collect_list(F.struct("at", "last"))).alias("_events"))
    first = F.get(F.filter("_events", lambda e: e["at"] >= F.col("_at")), F.lit(0))
    return rows.join(listed, ["project", "file"], "left").withColumn("path", F.coalesce(first["last"], F.col("file"))).drop("_events")


def file_history(files: DataFrame, renames: DataFrame | None = None, limit: int = K.HISTORY_LIMIT) -> DataFrame:
    """The newest ``limit`` commits of every file, renames followed; rank 1 is the newest."""
    rows = canonical_files(files, renames).select("project", "path", "sha", "log_pos").distinct()
    return top_n(rows, ["project", "path"], [F.col("log_pos").desc()], limit)


# --- line history ------------------------------------------------------------------

BIN = 64  # lines per bin of the range join


def _bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BIN), F.floor(end / BIN)))


def line_overlap(targets: DataFrame, hunks: DataFrame) -> DataFrame:
    """Targets (target_id, project, file, start, end) with the hunks whose new lines meet them.

    A range join as an equi-join on (project, file, bin); a pair that shares several bins is kept in the first
    common one, so no distinct is needed.
    """
    cut = targets.withColumn("_bin", _bins(F.col("start"), F.col("end")))
    spans = hunks.filter("new_count > 0").withColumn("new_end", F.col("new_start") + F.col("new_count") - 1)
    placed = spans.withColumn("_bin", _bins(F.col("new_start"), F.col("new_end")))
    met = cut.join(placed.withColumnRenamed("sha", "hit_sha").withColumnRenamed("log_pos", "hit_pos"), ["project", "file", "_bin"])
    first_common = F.floor(F.greatest("start", "new_start") / BIN) == F.col("_bin")
    return met.filter((F.col("new_start") <= F.col("end")) & (F.col("new_end") >= F.col("start")) & first_common)


def line_history(targets: DataFrame, hunks: DataFrame, segment: int = 256, limit: int = K.HISTORY_LIMIT, renames: DataFrame | None = None) -> DataFrame:
    """Commits behind the lines start..end of a file, at most ``limit`` per target, newest first.

    ``targets`` is (target_id, project, file, start, end); with a column ``own_pos`` its lines are those before that
    place in the log, otherwise the present ones.  A range is carried back commit by commit, because an edit above
    moves it; ``linemaps`` tells how that is done for long histories.  With ``renames`` (project, log_pos, old, new) lines are followed
    through the names of their file: edits and targets are taken to the name that their file has in the end.
    """
    own = F.col("own_pos").cast("bigint") if "own_pos" in targets.columns else F.lit(None).cast("bigint")
    wanted = targets.select(
        "project", "file", F.col("target_id").cast("string").alias("target_id"), own.alias("own_pos"),
        F.col("start").cast("bigint").alias("first"), F.col("end").cast("bigint").alias("last"))
    if renames is None:
        return linemaps.line_history(wanted, hunks, segment, limit)
    events = written(rename_events(renames))
    last_name = lambda rows, at: _last_names(rows.withColumn("_at", at), events).drop("_at", "file").withColumnRenamed("path", "file")
    # a present target has its last name already
    placed = written(last_name(wanted, F.coalesce("own_pos", F.lit((1 << 63) - 1))))
    # hunks count under the names that the targets have in the end, and under those that lead there
    ends = placed.select("project", "file")
    before = events.join(ends.withColumnRenamed("file", "last"), ["project", "last"], "left_semi").select("project", F.col("name").alias("file"))
    moved = last_name(sieved(hunks, ["project", "file"], ends.unionByName(before)), F.col("log_pos"))
    return linemaps.line_history(placed, moved, segment, limit)


# --- tests, files and folders ----------------------------------------------------------

def test_refs(files: DataFrame, snapshot: DataFrame, max_paths: int = 5, max_names: int = 8) -> DataFrame:
    """Tests that belong to the files of a commit: touched tests themselves, and ``tests/test_<name>`` where it exists.
    ``snapshot`` is (project, path, text)."""
    name = F.element_at(F.split("file", "/"), -1)
    own = F.startswith(name, F.lit("test_")) & F.endswith(name, F.lit(".py"))
    wanted = files.select(
        *COMMIT, F.when(own, F.col("file")).when(F.endswith(name, F.lit(".py")), F.concat(F.lit("tests/test_"), name)).alias("path"),
    ).filter("path IS NOT NULL").distinct()
    found = F.regexp_extract_all("text", F.lit(K.TEST_FUNC_PATTERN), F.lit(1))
    known = snapshot.select("project", "path", F.slice(found, 1, max_names).alias("names"))
    return top_n(wanted.join(known, ["project", "path"]), COMMIT, [F.col("path")], max_paths)


def best_file(files: DataFrame, noted: DataFrame, tracked: DataFrame) -> DataFrame:
    """The file to show first per project: a known source type, not a test, most commits with notes, most commits.
    ``noted`` holds the commits (project, sha) that carry notes."""
    rows = files.join(noted.select(*COMMIT, F.lit(1).alias("_noted")), COMMIT, "left")
    counts = rows.groupBy("project", "file").agg(F.count(F.lit(1)).alias("touches"), F.count("_noted").alias("grounded"))
    counts = counts.join(tracked.select("project", "file"), ["project", "file"], "left_semi")
    kinds = (".py", ".ts", ".tsx", ".js", ".jsx", ".md")
    kind = F.coalesce(*[F.when(F.endswith("file", F.lit(k)), F.lit(i)) for i, k in enumerate(kinds)], F.lit(99))
    is_test = F.startswith("file", F.lit("tests/")) | F.contains("file", F.lit("/test")) | F.startswith("file", F.lit("test_"))
    order = [kind, is_test, F.col("grounded").desc(), F.col("touches").desc(), F.col("file")]
    return top_n(counts, ["project"], order, 1).drop("rank")


def dir_rollup(paths: DataFrame) -> DataFrame:
    """Folder tree as rows: every node with its number of files and whether anything below it changed.
    ``paths`` is (path, changed)."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    nodes = paths.select(parts.alias("parts"), "changed").filter(F.size("parts") > 0).select(
        "changed", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))),
        F.size("parts").alias("_n"))
    return nodes.groupBy(F.col("col").alias("node")).agg(
        F.max(F.col("pos") + 1 < F.col("_n")).alias("is_dir"), F.bool_or("changed").alias("changed"),
        F.count(F.lit(1)).alias("files"))


def attribute(items: DataFrame, roots: DataFrame) -> DataFrame:
    """Items (item, path) to project roots (root): equal paths where a root has any, otherwise any path below it.

    Prefixes are exploded and matched by equality; no LIKE across tables.
    """
    exact = items.join(roots.select(F.col("root").alias("path"), "root"), "path").select("item", "root", F.lit("exact").alias("how"))
    rest = roots.join(exact.select("root").distinct(), "root", "left_anti")
    parts = F.split("path", "/")
    prefixes = items.select("item", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    below = prefixes.filter("root <> ''").join(rest.select("root"), "root").select("item", "root", F.lit("below").alias("how"))
    return exact.unionByName(below.distinct())


# --- chapters ----------------------------------------------------------------------------

def chapters(commits: DataFrame) -> DataFrame:
    """Commits with the number of their chapter: about √n chapters of equal length in time order."""
    placed = positions(commits, ["project"], F.to_date("date"), [F.col("log_pos")])
    totals = commits.groupBy("project").agg(F.count(F.lit(1)).alias("_n"))
    size = F.ceil(F.col("_n") / F.greatest(F.lit(1.0), F.bround(F.sqrt("_n"))))
    return placed.join(totals, "project").withColumn(
        "chapter", F.floor((F.col("position") - 1) / size) + 1).drop("_n")


def chapter_summaries(placed: DataFrame, narratives: DataFrame) -> DataFrame:
    """Title from the first commit, introduction from the first non-empty why."""
    joined = placed.join(narratives.select(*COMMIT, "why"), COMMIT, "left")
    told = F.trim(F.coalesce("why", F.lit(""))) != ""
    return joined.groupBy("project", "chapter").agg(
        F.concat(F.lit("第 "), F.first("chapter").cast("string"), F.lit(" 阶段:"),
                 F.substring(F.min_by("subject", "log_pos"), 1, 40)).alias("title"),
        F.coalesce(F.min_by(F.when(told, F.col("why")), F.when(told, F.col("log_pos"))), F.lit("(未智能编排)")).alias("intro"),
        F.count(F.lit(1)).alias("commits"), F.min_by("sha", "log_pos").alias("first_sha"), F.max_by("sha", "log_pos").alias("last_sha"))


def chapter_blocks(placed: DataFrame, narratives: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` commits of every chapter."""
    first = top_n(placed, ["project", "chapter"], [F.col("log_pos")], n)
    return first.join(narratives.select(*COMMIT, F.substring("what", 1, K.TIMELINE_EXCERPT).alias("what")), COMMIT, "left")


def chapter_items(placed: DataFrame, narratives: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The first ``n`` different risks or open loops of every chapter."""
    rows = placed.join(narratives.select(*COMMIT, F.posexplode(column).alias("_pos", "_item")), COMMIT)
    return first_texts(rows, ["project", "chapter"], F.col("_item"), F.struct("log_pos", "_pos"), n, column)


