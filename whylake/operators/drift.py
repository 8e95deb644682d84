"""Action drift: files a session wrote that no later commit on the same path picked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whylake import constants as K

SESSION = ["project", "source", "session_id"]


def written_files(sessions: DataFrame, session_files: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Per session and file the last known action time.  Parts of one session merge; sessions without a start and
    paths that are never committed (.git, ignore table) are left out."""
    rows = sessions.filter("started is not null").join(session_files.filter("mode = 'write'"), SESSION)
    rows = rows.filter("file <> '.git' and not startswith(file, '.git/')")
    if ignored is not None:
        rows = rows.join(ignored.select("project", "file"), ["project", "file"], "left_anti")
    return rows.groupBy(*SESSION, "file").agg(F.max("started").alias("acted_at"))


def drift_files(
    sessions: DataFrame, session_files: DataFrame, commit_files: DataFrame, ignored: DataFrame | None = None,
    slack_minutes: int = K.TIME_SLACK_MINUTES,
) -> DataFrame:
    """One row per (session, file) with ``landed``.

    "Some commit on the path is late enough" is the same as "the latest one is", so the history is reduced to one
    row per (project, file) before the join; no pair of session and commit is ever formed.
    """
    latest = commit_files.groupBy("project", "file").agg(F.max("date").alias("_latest"))
    slack = F.expr(f"interval {slack_minutes} minutes")
    return written_files(sessions, session_files, ignored).join(latest, ["project", "file"], "left").select(
        *SESSION, "file", "acted_at",
        F.coalesce(F.col("_latest") >= F.col("acted_at") - slack, F.lit(False)).alias("landed"))


def drift(drift_rows: DataFrame) -> DataFrame:
    """One row per session: counts and the missing paths in order."""
    return drift_rows.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("written"), F.count_if("landed").alias("committed"),
        F.array_sort(F.collect_list(F.when(~F.col("landed"), F.col("file")))).alias("missing"))


def flagged(summary: DataFrame) -> DataFrame:
    return summary.filter(F.size("missing") > 0)
