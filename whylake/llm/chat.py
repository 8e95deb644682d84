"""Chat formatting from every participant's view.

A dialogue is rendered once for each of its speakers: that speaker's turns become the assistant's, those of all others
the turns of a named user, and only the assistant's words are trained on.  System turns stay as they are in every view and
have no view of their own.  A row is one turn in one view: its text as rendered, where that begins and ends in the
rendered dialogue, and the part of it that the loss mask covers.

A dialogue may be long, so positions are summed in stretches of turns, and the totals of stretches are summed after that.

Cases: null texts are empty; a turn without a role is spoken by ``unknown``; turns without a number come last; turns with
equal numbers are ordered by speaker and text; a null conversation id is a conversation of its own; a dialogue of system
turns only has no view; repeated turns are rendered each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whylake.llm.common import table

SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns whose positions are summed together, as a power of two.
STRETCH_BITS = 8
LAST = (1 << 63) - 1


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, chat_role, name, rendered, start, stop, mask_start, mask_stop), ends exclusive."""
    # a null id as a pair of plain keys, so that window and joins can share one partitioning
    key = [F.coalesce(F.col(conv), F.lit(0).cast(turns.schema[conv].dataType)).alias("k"), F.col(conv).isNull().alias("k_null")]
    own = turns.select(
        *key, F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    views = own.where(F.col("speaker") != SYSTEM).select("k", "k_null", F.col("speaker").alias("perspective")).distinct()
    seen = own.join(views, ["k", "k_null"])
    chat_role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    seen = seen.withColumn("chat_role", chat_role).withColumn("name", F.when(F.col("chat_role") == "user", F.col("speaker")))
    head = F.concat(F.lit(OPEN), F.col("chat_role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    seen = seen.withColumn("head_chars", F.length(head)).withColumn("rendered", F.concat(head, F.col("body"), F.lit(CLOSE)))
    place = F.coalesce("turn", F.lit(LAST))
    seen = seen.withColumn("place", place).withColumn("stretch", F.shiftright(place, STRETCH_BITS)).withColumn("chars", F.length("rendered").cast("long"))

    group = ["k", "k_null", "perspective", "stretch"]
    inside = Window.partitionBy(*group).orderBy("place", "speaker", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = seen.groupBy(*group).agg(F.sum("chars").alias("total"))
    before = Window.partitionBy("k", "k_null", "perspective").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    whole = seen.withColumn("stop", F.sum("chars").over(inside)).join(bases, group)
    stop = F.col("base") + F.col("stop")
    start = stop - F.col("chars")
    trained = F.col("chat_role") == "assistant"
    return whole.select(
        "conv_id", "perspective", "turn", "chat_role", "name", "rendered", start.alias("start"), stop.alias("stop"),
        F.when(trained, start + F.col("head_chars")).alias("mask_start"), F.when(trained, stop - 1).alias("mask_stop"))


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask covers the words and the closing mark, without the line end after it."""
    return rotate(table(spark, sf_dir, "conversations"))


SQL = """
WITH own AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
views AS (SELECT DISTINCT conv_id AS v_conv, speaker AS perspective FROM own WHERE speaker <> 'system'),
seen AS (
  SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM own JOIN views ON conv_id IS NOT DISTINCT FROM v_conv),
named AS (SELECT *, CASE WHEN chat_role = 'user' THEN speaker END AS name FROM seen),
headed AS (SELECT *, '<|im_start|>' || chat_role || coalesce(' name=' || name, '') || chr(10) AS head FROM named),
drawn AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM headed),
placed AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, body
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop FROM drawn)
SELECT conv_id, perspective, turn, chat_role, name, rendered, stop - length(rendered) AS start, stop,
  CASE WHEN chat_role = 'assistant' THEN stop - length(rendered) + length(head) END AS mask_start,
  CASE WHEN chat_role = 'assistant' THEN stop - 1 END AS mask_stop
FROM placed"""
