"""How much of the history can be explained, and from what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions import notes
from whylake.functions.text import percent
from whylake.operators.history import line_history
from whylake.operators.ranking import top_n

COMMIT = ["project", "sha"]


def hit_rate(commits: DataFrame, narratives: DataFrame) -> DataFrame:
    """Per project: commits with notes, with evidence, with either (real) and with anything at all (loose)."""
    joined = commits.select(*COMMIT, notes.has_notes(F.col("body")).alias("noted")).join(
        narratives.select(*COMMIT, F.lit(True).alias("narrated"), F.trim("why").alias("why"),
                          F.size("decisions").alias("n_dec"), "n_evidence"), COMMIT, "left")
    evident = F.coalesce("n_evidence", F.lit(0)) > 0
    real = F.col("noted") | evident
    loose = real | (F.coalesce("why", F.lit("")) != "") | (F.coalesce("n_dec", F.lit(0)) > 0)
    out = joined.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"), F.count("narrated").alias("narrated"), F.count_if("noted").alias("noted"),
        F.count_if(evident).alias("evidence"), F.count_if(real).alias("real_grounded"), F.count_if(loose).alias("grounded"))
    pct = lambda c: percent(F.col(c), F.col("total"))
    return out.withColumns({
        "real_pct": pct("real_grounded"), "depth_pct": pct("evidence"), "coverage_pct": pct("grounded"),
        "narrated_pct": pct("narrated")})


def by_source(commits: DataFrame, quoted: DataFrame, tested: DataFrame, discussed: DataFrame) -> DataFrame:
    """One row per commit with the four kinds of checkable material; rejected notes do not count here.
    The last three inputs are sets of (project, sha).  All flags meet in one aggregation."""
    marks = ("has_quote", "has_test", "has_pr")
    no = F.lit(False)
    rows = commits.select(
        *COMMIT, "subject", F.lit(True).alias("_known"), notes.has_notes(F.col("body"), (K.NOTE_DECISION, K.NOTE_WATCH)).alias("has_note"),
        *(no.alias(m) for m in marks))
    for mark, known in zip(marks, (quoted, tested, discussed), strict=True):
        rows = rows.unionByName(known.select(
            *COMMIT, F.lit(None).cast("string").alias("subject"), no.alias("_known"), no.alias("has_note"), *(F.lit(m == mark).alias(m) for m in marks)))
    out = rows.groupBy(*COMMIT).agg(F.max("subject").alias("subject"), *(F.bool_or(c).alias(c) for c in ("_known", "has_note", *marks)))
    return out.filter("_known").drop("_known").withColumn("grounded", F.greatest("has_note", *marks))


def source_totals(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy("project").agg(
        n.alias("total"), F.count_if("has_quote").alias("quotes"), F.count_if("has_test").alias("tests"),
        F.count_if("has_pr").alias("prs"), F.count_if("has_note").alias("notes"), F.count_if("grounded").alias("grounded"),
        F.count_if(~F.col("grounded")).alias("at_risk"),
        F.floor(F.count_if("grounded") * 100 / n).alias("pct"))


def note_stats(commits: DataFrame) -> DataFrame:
    body = F.col("body")
    counted = commits.select(
        "project", F.size(notes.decisions(body)).alias("d"), F.size(notes.watches(body)).alias("w"),
        F.size(notes.rejected(body)).alias("r"))
    out = counted.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.expr("d + w + r > 0")).alias("rich"), F.sum("d").alias("decisions"),
        F.sum("w").alias("watches"), F.sum("r").alias("rejected"))
    pct = F.bround(F.col("rich") / F.col("total") * 100).cast("bigint")
    return out.withColumn("pct", pct).withColumn(
        "tier", F.when(F.col("pct") >= 25, "rich").when(F.col("rich") > 0, "partial").otherwise("cold-start"))


def last_n(commits: DataFrame, n: int = 20) -> DataFrame:
    """Notes among the newest ``n`` commits of each project."""
    recent = top_n(commits.select("project", "log_pos", "body"), ["project"], [F.col("log_pos").desc()], n)
    return recent.groupBy("project").agg(
        F.count_if(notes.has_notes(F.col("body"))).alias("got"), F.count(F.lit(1)).alias("total")).withColumn(
        "pct", F.bround(F.col("got") / F.col("total") * 100).cast("bigint"))


def narrative_gap(commits: DataFrame, narratives: DataFrame) -> DataFrame:
    """Projects with commits that have no narrative yet."""
    joined = commits.select(*COMMIT).join(narratives.select(*COMMIT, F.lit(1).alias("_n")), COMMIT, "left")
    out = joined.groupBy("project").agg(F.count(F.lit(1)).alias("total"), F.count("_n").alias("narrated"))
    return out.withColumn("missing", F.col("total") - F.col("narrated")).filter("missing > 0").withColumn(
        "pct", percent(F.col("narrated"), F.col("total")))


def sample_lines(lines: DataFrame, n: int, seed: int = 1729) -> DataFrame:
    """A reproducible sample of ``n`` (path, line) rows: the smallest seeded hashes, a distributed top-n."""
    return lines.orderBy(F.md5(F.concat_ws(":", "path", "line", F.lit(seed))), "path", "line").limit(n)


def line_recall(targets: DataFrame, hunks: DataFrame, explained: DataFrame, limit: int = K.HISTORY_LIMIT) -> DataFrame:
    """Per project: lines where some commit of their history explains itself (window), where the newest does
    (strict), and lines without history.  ``explained`` is (project, sha, log_pos, has_why).

    What a commit says about itself travels in place of its SHA through the history, which is far larger than that of the hunks.
    Commits are named by their place in the log, or by their SHA where that is missing.
    """
    place = lambda df: df.withColumns({"_named": F.when(F.col("log_pos").isNull(), F.col("sha")), "_is": F.col("sha").isNotNull()})
    said = place(explained).groupBy("project", F.col("log_pos").alias("_at"), "_named").agg(F.bool_or("has_why").alias("has_why"))
    said = said.withColumnsRenamed({"project": "_project", "_named": "_other"})
    known = place(hunks).join(said, (F.col("project") == F.col("_project")) & F.col("log_pos").eqNullSafe(F.col("_at")) & F.col("_named").eqNullSafe(F.col("_other")), "left")
    mark = F.concat(F.coalesce(F.col("has_why").cast("int").cast("string"), F.lit("?")), F.coalesce("_named", F.lit("")))
    marked = known.withColumn("sha", F.when(F.col("_is"), mark)).select(*hunks.columns)
    recent = line_history(targets, marked, limit=limit).select("target_id", "log_pos", (F.substring("sha", 1, 1) == "1").alias("yes"), F.startswith("sha", F.lit("?")).alias("unknown"))
    judged = recent.select("target_id", "log_pos", F.when(~F.col("unknown"), F.col("yes")).alias("has_why"))
    per_line = judged.groupBy("target_id").agg(
        F.bool_or("has_why").alias("window"), F.max_by("has_why", "log_pos").alias("strict"))
    out = targets.select("project", "target_id").join(per_line, "target_id", "left")
    return out.groupBy("project").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if("window").alias("window"), F.count_if("strict").alias("strict"),
        F.count_if(F.col("window").isNull()).alias("no_history"))
