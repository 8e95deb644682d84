"""Usage log: cleaning and the self report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whylake.functions.text import parse_time


def clean(lines: DataFrame) -> DataFrame:
    """JSON lines to rows; lines that are no JSON object or lack ``command`` or ``ts`` are dropped.
    A count that is no number counts as 0."""
    v = lines.select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    number = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "double"), F.lit(0.0)).cast("bigint").alias(k)
    rows = v.filter(text("command").isNotNull() & text("ts").isNotNull())
    return rows.select(
        text("command").alias("command"), text("project").alias("project"), parse_time(text("ts")).alias("ts"),
        number("llm_calls"), number("tokens_in"), number("tokens_out"), number("cache_hit_tokens"))


def within(usage: DataFrame, bound) -> DataFrame:
    return usage.filter(F.col("ts") >= F.lit(bound))


def report(usage: DataFrame) -> DataFrame:
    """Runs per command, and one total row (``command`` NULL)."""
    out = usage.rollup("command").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("llm_calls").alias("llm_calls"), F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"), F.sum("cache_hit_tokens").alias("cache_hit_tokens"), F.count_if(F.col("llm_calls") == 0).alias("zero_call_runs"))
    return out.withColumn("share", F.floor(F.col("zero_call_runs") * 100 / F.col("runs")))


def last_run(usage: DataFrame, command: str) -> DataFrame:
    return usage.filter(F.col("command") == command).groupBy("project").agg(F.max("ts").alias("last_run"))
