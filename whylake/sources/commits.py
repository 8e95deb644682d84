"""Exported commit history.

One file per project, named ``<project name>.<ext>``; ``roots`` maps the file name to the project key where given.
Records are split by Spark itself (``lineSep``), so a large export is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions.redact import redact
from whylake.functions.text import bounded_text, lines, strip
from whylake.operators.ranking import positions

SHA = "^[0-9a-f]{40}$"


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", "")


def _records(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", K.RECORD_SEP).text(path)
    return raw.select(
        F.regexp_replace("value", r"^[\n\x00]+|\n+$", "").alias("value"), file_stem(F.col("_metadata.file_path")).alias("project"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")).filter("value <> ''")


def _log_order(rows: DataFrame) -> DataFrame:
    """``log_pos`` from the place in the file: the export is newest first, positions count from the oldest.
    Numbered block by block, so no file is sorted in one task."""
    return positions(rows, ["project"], -F.col("_block"), [F.col("_row").desc()], "log_pos").drop("_block", "_row")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """``%H %aI %an %s %b`` separated by \\x1f, records ended by \\x1e.  Short records and unreadable dates are dropped."""
    parts = F.split("value", K.FIELD_SEP)
    rows = _records(spark, path).withColumn("p", parts).filter(F.size("p") >= 4).select(
        "project", F.col("p")[0].alias("sha"), F.try_to_timestamp(F.col("p")[1]).alias("date"), F.col("p")[2].alias("author"),
        F.col("p")[3].alias("subject"), strip(F.coalesce(F.get("p", F.lit(4)), F.lit(""))).alias("body"), "_block", "_row")
    return _log_order(rows.filter("date IS NOT NULL"))


def read_commit_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Commits and their files from a name-only export: records begin with \\x1e, files are separated by NUL, the first
    one follows the last newline of the message.  A record that does not begin with a SHA is dropped."""
    tokens = F.split("value", "\x00")
    rows = _records(spark, path).withColumn("t", tokens).withColumn("first", F.col("t")[0])
    cut = r"(?s)^(.+)\n([^\n]*)$"
    has_file = F.regexp_like("first", F.lit(cut))
    meta = F.when(has_file, F.regexp_extract("first", cut, 1)).otherwise(F.col("first"))
    named = F.concat(
        F.when(has_file, F.array(F.regexp_extract("first", cut, 2))).otherwise(F.array().cast("array<string>")),
        F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))))
    parsed = rows.select("project", "_block", "_row", F.split(meta, K.FIELD_SEP).alias("p"), F.filter(named, lambda f: strip(f) != "").alias("files"))
    good = parsed.filter(F.size("p") >= 3).filter(F.regexp_like(F.col("p")[0], F.lit(SHA))).select(
        "project", F.col("p")[0].alias("sha"), F.try_to_timestamp(F.col("p")[1]).alias("date"), F.col("p")[2].alias("subject"),
        strip(F.coalesce(F.get("p", F.lit(3)), F.lit(""))).alias("body"), "files", "_block", "_row").filter("date IS NOT NULL")
    placed = _log_order(good)
    files = placed.select("project", "sha", "log_pos", "date", F.explode("files").alias("file")).distinct()
    return placed.drop("files"), files


def read_patches(spark: SparkSession, path: str, budget: int) -> DataFrame:
    """Patch files ``<project>/<sha>.patch``, one per commit, to (project, sha, diff) with a marked cut at ``budget``."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    place = F.split("_metadata.file_path", "/")
    return raw.select(
        F.url_decode(F.element_at(place, -2)).alias("project"), file_stem(F.col("_metadata.file_path")).alias("sha"),
        strip(bounded_text(F.col("value"), budget)).alias("diff"))


def read_tracked(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of tracked files, one list per project.  A project without a list is simply absent, and operators keep
    all of its files."""
    raw = spark.read.text(path)
    return raw.filter("value <> ''").select(
        file_stem(F.col("_metadata.file_path")).alias("project"), F.col("value").alias("file")).distinct()


def project_context(snapshot: DataFrame) -> DataFrame:
    """Background text of a project from (project, path, text): the first of the two known files that has any."""
    rank = F.coalesce(*[F.when(F.col("path") == name, F.lit(i)) for i, name in enumerate(K.PROJECT_CONTEXT_FILES)])
    rows = snapshot.withColumn("_rank", rank).filter("_rank IS NOT NULL").withColumn("text", strip(F.col("text"))).filter("text <> ''")
    return rows.groupBy("project").agg(F.min_by("text", "_rank").alias("context")).withColumn(
        "context", F.substring("context", 1, K.PROJECT_CONTEXT_CAP))


def pull_requests(rows: DataFrame) -> DataFrame:
    """The first request per commit with a bounded, redacted snippet; input (project, sha, place, number, url, title, body)."""
    first = rows.groupBy("project", "sha").agg(F.min_by(F.struct("number", "url", "title", "body"), "place").alias("p"))
    return first.select(
        "project", "sha", "p.number", "p.url", redact(F.coalesce("p.title", F.lit(""))).alias("title"),
        F.substring(redact(F.coalesce("p.body", F.lit(""))), 1, K.PR_SNIPPET_CAP).alias("snippet"))


def source_lines(snapshot: DataFrame) -> DataFrame:
    """Numbers of the non-blank lines of each file."""
    rows = snapshot.select("project", "path", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    return rows.filter(strip(F.col("line")) != "").select("project", "path", (F.col("pos") + 1).alias("line"))
