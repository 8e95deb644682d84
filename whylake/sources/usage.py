"""Usage log and written reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whylake.operators import usage
from whylake.sources.commits import file_stem


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return usage.clean(spark.read.text(path))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Daily reports ``<day>-<name>.md`` to (project, day, text).  The name is matched whole, so the report of a project
    never counts for another whose name ends alike."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    pattern = r"^(\d{4}-\d{2}-\d{2})-(.+)$"
    stem = file_stem(F.col("_metadata.file_path"))
    return raw.withColumn("_stem", stem).filter(F.regexp_like("_stem", F.lit(pattern))).select(
        F.regexp_extract("_stem", pattern, 2).alias("project"), F.to_date(F.regexp_extract("_stem", pattern, 1)).alias("day"),
        F.col("value").alias("text"))
