"""Narratives as a model wrote them: JSON of doubtful shape, brought to the table form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whylake.functions import notes
from whylake.functions import variants as V
from whylake.functions.redact import redact

LISTS = ("decisions", "risks", "open_loops", "rejected")


def _texts(value: Column, path: str) -> Column:
    """A list of texts at ``path``: items turned to text, a single value wrapped, nothing when it is missing."""
    found = F.try_variant_get(value, path, "variant")
    items = F.transform(F.try_variant_get(found, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    empty = F.array().cast("array<string>")
    single = F.try_variant_get(found, "$", "string")
    is_list = F.startswith(F.schema_of_variant(found), F.lit("ARRAY"))
    return F.when(found.isNull(), empty).when(is_list, items).when(single.isNotNull(), F.array(single)).otherwise(empty)


def normalize(rows: DataFrame) -> DataFrame:
    """(project, sha, json) to typed columns.  Filler is dropped from the inferred lists, never from decisions."""
    v = V.parse(F.col("json"))
    parsed = rows.withColumn("v", v).filter(V.is_object(F.col("v")))
    word = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit("")).alias(k)
    return parsed.select(
        "project", "sha", word("what"), word("why"), _texts(F.col("v"), "$.decisions").alias("decisions"),
        notes.without_filler(_texts(F.col("v"), "$.risks")).alias("risks"),
        notes.without_filler(_texts(F.col("v"), "$.open_loops")).alias("open_loops"),
        _texts(F.col("v"), "$.rejected").alias("rejected"))


def with_notes(normalized: DataFrame, commits: DataFrame) -> DataFrame:
    """Fold the commit's own notes in, as they are stored: decisions without repeats, watches behind the risks.
    Everything is redacted."""
    body = F.col("body")
    joined = normalized.join(commits.select("project", "sha", "body"), ["project", "sha"], "left")
    own = F.coalesce(notes.watches(body), F.array().cast("array<string>"))
    return joined.select(
        "project", "sha", redact(F.col("what")).alias("what"), redact(F.col("why")).alias("why"),
        notes.redacted_list(notes.merged(F.col("decisions"), notes.decisions(body))).alias("decisions"),
        notes.redacted_list(F.concat("risks", own)).alias("risks"),
        notes.redacted_list(F.col("open_loops")).alias("open_loops"), notes.redacted_list(F.col("rejected")).alias("rejected"))


def stubs(commits: DataFrame, trivial: DataFrame) -> DataFrame:
    """Narratives of mechanical commits, which need no model."""
    none = F.array().cast("array<string>")
    return commits.join(trivial.select("project", "sha"), ["project", "sha"], "left_semi").select(
        "project", "sha", redact(F.col("subject")).alias("what"), F.lit("机械改动(lockfile/生成文件),未叙事").alias("why"),
        none.alias("decisions"), none.alias("risks"), none.alias("open_loops"), none.alias("rejected"))


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of history segments as JSON (target_id, json) split into usable ones and those with a field of the wrong type;
    the latter count as no evidence."""
    v = V.parse(F.col("json"))
    fields = ("decisions", "rejected", "authored_decisions", "authored_rejected", "generated_decisions", "generated_rejected",
              "evidence", "test_refs", "pr_refs")
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    usable = V.is_object(F.col("v")) & F.coalesce(kind("why") == "STRING", F.lit(True))
    for name in fields:
        usable = usable & F.coalesce(F.startswith(kind(name), F.lit("ARRAY")), F.lit(True))
    checked = rows.withColumn("v", v).withColumn("_ok", F.coalesce(usable, F.lit(False)))
    return checked.filter("_ok").drop("_ok", "v"), checked.filter("NOT _ok").drop("_ok", "v")
