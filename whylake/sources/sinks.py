"""Writing state tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whylake.functions.redact import redact_columns
from whylake.session import cut_lineage


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_usage(df: DataFrame, path: str) -> None:
    """Usage rows as JSON lines; string leaves are redacted before they are encoded."""
    redact_columns(df).write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite only the partitions present in ``df``.

    The rows usually derive from the same table, so they are checkpointed to shared storage first: a task that is
    retried after files were replaced must not read its own output.
    """
    cut_lineage(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def touched(current: DataFrame, incoming: DataFrame, partition_by: list[str]) -> DataFrame:
    """The part of a table that a write of ``incoming`` has to rewrite."""
    return current.join(incoming.select(*partition_by).distinct(), partition_by, "left_semi")


def write_index(postings: DataFrame, table: str, buckets: int) -> None:
    """Search index bucketed by trigram, so that lookups of the same trigrams need no shuffle of the index."""
    postings.write.mode("overwrite").bucketBy(buckets, "trigram").sortBy("trigram").saveAsTable(table)


def write_report_lines(lines: DataFrame, path: str) -> None:
    """Daily reports as ordered text files, one folder per project and day.

    The encoded project is part of the sort, so the writer sees its order of folders and adds no sort of its own.
    """
    named = lines.withColumn("project", F.url_encode("project")).repartition("project", "day")
    ordered = named.sortWithinPartitions("project", "day", "section", "log_pos", "part")
    ordered.select("project", "day", F.col("line").alias("value")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("project", "day").text(path)


def write_documents(documents: DataFrame, path: str, key: list[str], text: str) -> None:
    """Documents (decision notes, decision records, graph files) in one folder per key; writing again replaces them."""
    cut_lineage(documents.select(*[F.url_encode(k).alias(k) for k in key], F.col(text).alias("value"))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*key).text(path)
