"""Soft alignment of commits with assistant sessions, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.operators.ranking import top_n

SESSION = ["project", "source", "session_id"]
# Widths of the time buckets in hours.  A session is cut into buckets of the finest width that needs at most 24 of
# them, so a session of any length explodes into a bounded number of rows (up to two years; one per month beyond).
LEVELS = (1, 24, 720)


def _hours(ts: Column) -> Column:
    """Hours since 1970 on the wall clock; needs no time zone, so it serves both kinds of timestamp."""
    return F.datediff(ts, F.lit("1970-01-01")).cast("bigint") * 24 + F.hour(ts)


def time_pairs(commits: DataFrame, sessions: DataFrame, slack_minutes: int = K.TIME_SLACK_MINUTES) -> DataFrame:
    """Commits inside a session widened by the slack on both ends (inclusive).

    An interval join as an equi-join on (project, width, bucket): a commit falls into one bucket per width and a
    session uses one width, so no pair appears twice.
    """
    slack = F.expr(f"interval {slack_minutes} minutes")
    spans = sessions.filter("started is not null and ended is not null").select(
        *SESSION, (F.col("started") - slack).alias("_from"), (F.col("ended") + slack).alias("_to"))
    length = _hours(F.col("_to")) - _hours(F.col("_from"))
    width = F.when(length <= 24 * LEVELS[0], LEVELS[0]).when(length <= 24 * LEVELS[1], LEVELS[1]).otherwise(LEVELS[2])
    cut = spans.withColumn("_width", width).withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(_hours(F.col("_from")) / F.col("_width")), F.floor(_hours(F.col("_to")) / F.col("_width")))),
    )
    placed = commits.select("project", "sha", "date", F.explode(F.array(*[F.lit(w) for w in LEVELS])).alias("_width")).withColumn(
        "_bucket", F.floor(_hours(F.col("date")) / F.col("_width")))
    return placed.join(cut, ["project", "_width", "_bucket"]).filter("date between _from and _to").select(
        "project", "sha", "source", "session_id")


def file_pairs(files: DataFrame, session_files: DataFrame) -> DataFrame:
    """Commits and sessions that wrote the same file, one row per shared file.  Hot (project, file) keys are split
    by adaptive skew join, as the aggregation that follows shuffles on another key anyway."""
    written = session_files.filter("mode = 'write'").select(*SESSION, "file").distinct()
    return files.select("project", "sha", "file").join(written, ["project", "file"])


def align(commits: DataFrame, files: DataFrame, sessions: DataFrame, session_files: DataFrame) -> DataFrame:
    """All matches: ``high`` when time and files agree, ``low`` when only one does; shared files listed in order."""
    by_time = time_pairs(commits, sessions).withColumn("file", F.lit(None).cast("string"))
    both = by_time.unionByName(file_pairs(files, session_files).select(*by_time.columns))
    pairs = both.groupBy("project", "sha", "source", "session_id").agg(
        F.max(F.col("file").isNull()).alias("in_window"), F.array_sort(F.collect_set("file")).alias("overlap"))
    return pairs.select(
        "project", "sha", "source", "session_id", "overlap", F.size("overlap").cast("bigint").alias("n_overlap"),
        F.when(F.col("in_window") & (F.size("overlap") > 0), "high").otherwise("low").alias("confidence"))


def best_matches(matches: DataFrame, n: int = 2) -> DataFrame:
    """The best ``n`` sessions of each commit: high before low, more shared files first."""
    order = [(F.col("confidence") != "high"), F.col("n_overlap").desc(), F.col("source"), F.col("session_id")]
    return top_n(matches, ["project", "sha"], order, n)


def best_sessions(
    commits: DataFrame, files: DataFrame, sessions: DataFrame, session_files: DataFrame, n: int = 2,
) -> DataFrame:
    """The same rows as ``best_matches(align(...))`` without forming all matches first.

    Strong matches lie inside the time window, where pairs are few.  A commit that has ``n`` of them is settled; only
    the others are matched by files alone, which is where a file touched by everything would multiply.
    """
    timed = time_pairs(commits, sessions)
    written = session_files.filter("mode = 'write'").select(*SESSION, "file").distinct()
    strong = timed.join(files.select("project", "sha", "file"), ["project", "sha"]).join(written, [*SESSION, "file"]).groupBy(
        "project", "sha", "source", "session_id").agg(F.count(F.lit(1)).alias("n_overlap"))
    strong = top_n(strong, ["project", "sha"], [F.col("n_overlap").desc(), F.col("source"), F.col("session_id")], n)
    settled = strong.groupBy("project", "sha").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n).drop("_n")
    first = strong.join(settled, ["project", "sha"], "left_semi").withColumn("confidence", F.lit("high"))

    open_time = timed.join(settled, ["project", "sha"], "left_anti").withColumn("file", F.lit(None).cast("string"))
    open_files = files.select("project", "sha", "file").join(settled, ["project", "sha"], "left_anti")
    pairs = open_time.unionByName(file_pairs(open_files, session_files).select(*open_time.columns)).groupBy(
        "project", "sha", "source", "session_id").agg(
        F.max(F.col("file").isNull()).alias("_timed"), F.count("file").alias("n_overlap"))
    judged = pairs.withColumn("confidence", F.when(F.col("_timed") & (F.col("n_overlap") > 0), "high").otherwise("low")).drop("_timed")
    rest = best_matches(judged, n)
    return first.unionByName(rest.select(*first.columns))


def evidence(best: DataFrame, sessions: DataFrame) -> DataFrame:
    """Evidence records of a commit: up to two sessions with three prompts and two excerpts each.

    ``best`` comes from ``best_sessions`` or ``best_matches``; ``sessions`` carries ``prompts`` and ``excerpts`` arrays
    (already capped by the roll-up) and ``ended``."""
    return best.join(sessions, SESSION, "left").select(
        "project", "sha", "rank", "session_id", "source", F.col("ended").alias("ts"), "confidence",
        F.slice("prompts", 1, 3).alias("prompts"), F.slice("excerpts", 1, 2).alias("excerpts"))


def session_commits(matches: DataFrame, commits: DataFrame, n: int | None = None) -> DataFrame:
    """Reverse view: the distinct commits of each session, oldest first, ``n`` of them or all."""
    rows = matches.join(commits.select("project", "sha", "log_pos", "subject"), ["project", "sha"]).select(
        *SESSION, F.substring("sha", 1, 7).alias("sha7"), "subject", "log_pos")
    unique = rows.groupBy(*SESSION, "sha7", "subject").agg(F.min("log_pos").alias("log_pos"))
    return unique if n is None else top_n(unique, SESSION, [F.col("log_pos"), F.col("sha7")], n)


def first_commits(commits: DataFrame, files: DataFrame, sessions: DataFrame, session_files: DataFrame, n: int, slack_minutes: int = K.TIME_SLACK_MINUTES) -> DataFrame:
    """The rows of ``session_commits(align(...), commits, n)`` without the list of all matches.

    A session's ``n`` earliest commits are among the earliest of each of its files, and of each time bucket that it covers whole;
    only the buckets at both of its ends are looked through.  So a session meets n rows for a file or a bucket, however many
    commits they hold.
    """
    order = [F.col("log_pos"), F.col("sha7")]
    known = commits.select("project", "sha", F.substring("sha", 1, 7).alias("sha7"), "subject", "log_pos", "date").distinct()
    named = known.select("project", "sha", "sha7", "subject", "log_pos")

    # commits that read the same are one, so they are counted once in every list
    per_file = files.select("project", "sha", "file").distinct().join(named, ["project", "sha"]).groupBy("project", "file", "sha7", "subject").agg(F.min("log_pos").alias("log_pos"))
    written = session_files.filter("mode = 'write'").select(*SESSION, "file").distinct()
    by_file = top_n(per_file, ["project", "file"], order, n).drop("rank").join(written, ["project", "file"]).select(*SESSION, "sha7", "subject", "log_pos")

    slack = F.expr(f"interval {slack_minutes} minutes")
    spans = sessions.filter("started is not null and ended is not null").select(
        *SESSION, (F.col("started") - slack).alias("_from"), (F.col("ended") + slack).alias("_to"))
    length = _hours(F.col("_to")) - _hours(F.col("_from"))
    width = F.when(length <= 24 * LEVELS[0], LEVELS[0]).when(length <= 24 * LEVELS[1], LEVELS[1]).otherwise(LEVELS[2])
    low, high = F.floor(_hours(F.col("_from")) / F.col("_width")), F.floor(_hours(F.col("_to")) / F.col("_width"))
    cut = spans.withColumn("_width", width).withColumns({"_low": low, "_high": high})
    placed = known.select("project", "sha7", "subject", "log_pos", "date", F.explode(F.array(*[F.lit(w) for w in LEVELS])).alias("_width")).withColumn(
        "_bucket", F.floor(_hours(F.col("date")) / F.col("_width")))
    ends = cut.withColumn("_bucket", F.explode(F.array_distinct(F.array("_low", "_high"))))
    at_ends = placed.join(ends, ["project", "_width", "_bucket"]).filter("date between _from and _to").select(*SESSION, "sha7", "subject", "log_pos")
    earliest = placed.groupBy("project", "_width", "_bucket", "sha7", "subject").agg(F.min("log_pos").alias("log_pos"))
    inner = cut.filter("_high - _low > 1").withColumn("_bucket", F.explode(F.sequence(F.col("_low") + 1, F.col("_high") - 1)))
    inside = top_n(earliest, ["project", "_width", "_bucket"], order, n).drop("rank").join(inner, ["project", "_width", "_bucket"]).select(*SESSION, "sha7", "subject", "log_pos")

    unique = by_file.unionByName(at_ends).unionByName(inside).groupBy(*SESSION, "sha7", "subject").agg(F.min("log_pos").alias("log_pos"))
    return top_n(unique, SESSION, order, n)
