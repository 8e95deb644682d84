"""What a question is about: a file, some of its lines, or a stretch of time, and what is on record about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.operators.history import line_history
from whylake.operators.ranking import among, sieved, top_n
from whylake.operators.rendering import context_line
from whylake.session import written

FILE = ["project", "file"]
#: Days of a bucket in which the commits of a stretch of time are looked up.
BUCKET_DAYS = 32


def retrieve(targets: DataFrame, commits: DataFrame, files: DataFrame, hunks: DataFrame, limit: int = K.HISTORY_LIMIT, renames: DataFrame | None = None) -> DataFrame:
    """(target_id, kind, project, sha, log_pos, rank): the newest ``limit`` commits behind each target.

    ``targets`` is (target_id, project, file, start, end, since, until).  With lines it is their history (``line``); where a file
    has no line data, or no lines are asked for, that of the file (``file``); without a file all commits of the project
    from ``since`` on and before ``until`` (``time``), which both have to be given then.  ``since`` narrows the others too.
    """
    targets = written(targets)
    lines = targets.filter("file IS NOT NULL AND start IS NOT NULL")
    if renames is None:  # no other hunks are looked at
        hunks = written(among(hunks, FILE, lines))
    mapped = hunks.select(*FILE).distinct()
    followed = line_history(lines.join(mapped, FILE, "left_semi").select("target_id", *FILE, "start", "end"), hunks, limit=limit, renames=renames)
    by_line = followed.select("target_id", F.lit("line").alias("kind"), "project", "sha", "log_pos")

    whole = targets.filter("file IS NOT NULL AND start IS NULL").unionByName(lines.join(mapped, FILE, "left_anti").select(*targets.columns))
    by_file = sieved(files.select(*FILE, "sha", "log_pos"), FILE, whole).join(whole.select("target_id", *FILE), FILE).select(
        "target_id", F.lit("file").alias("kind"), "project", "sha", "log_pos")

    # an equi-join on buckets of days; a commit lies in one bucket, so no pair repeats
    bucket = lambda at: F.floor(F.datediff(at, F.lit("1970-01-01")) / BUCKET_DAYS)
    times = targets.filter("file IS NULL").select("target_id", "project", "since", "until").withColumn(
        "_bucket", F.explode(F.sequence(bucket(F.col("since")), bucket(F.col("until")))))
    dated = commits.select("project", "sha", "log_pos", "date").withColumn("_bucket", bucket(F.col("date")))
    by_time = sieved(dated, ["project", "_bucket"], times).join(times, ["project", "_bucket"]).filter("date >= since AND date < until").select(
        "target_id", F.lit("time").alias("kind"), "project", "sha", "log_pos")

    # written: at most ``limit`` rows for each target, read several times by what is looked up behind them
    newest = written(top_n(by_line.unionByName(by_file).unionByName(by_time), ["target_id"], [F.col("log_pos").desc()], limit))
    # the newest of all, less those before ``since``, are the newest from then on
    dates = sieved(commits.select("project", "sha", "date"), ["project", "sha"], newest)
    asked = newest.join(targets.select("target_id", "since"), "target_id").join(dates, ["project", "sha"])
    return written(asked.filter("since IS NULL OR date >= since").select("target_id", "kind", "project", "sha", "log_pos", "rank"))


def contexts(history: DataFrame, segments: DataFrame) -> DataFrame:
    """(target_id, commits, newest, context): the records behind each target, oldest first, as one text."""
    told = segments.select("project", "sha", context_line().alias("line"))
    rows = history.join(told, ["project", "sha"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("log_pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("target_id", "kind").agg(
        F.count(F.lit(1)).alias("commits"), F.max_by("sha", "log_pos").alias("newest"), F.substring(joined, 1, K.CONTEXT_BUDGET).alias("context"))
