"""Capsules: predictions sealed with a commit, opened when due, answered later."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions import notes
from whylake.functions.redact import redact
from whylake.functions.text import lines
from whylake.operators.ranking import top_n


def seal(commits: DataFrame, narratives: DataFrame, days: int = K.CAPSULE_DAYS, short_window: bool = False) -> DataFrame:
    """New capsules: only risks that repeat a watch note of the same commit word for word (both sides redacted).
    ``capsule_id`` carries the place of the risk in the list.  With ``days`` = 0 nothing is sealed unless the short
    window is asked for, as such a capsule would be due on the day it is replayed."""
    days = max(0, days)
    watched = commits.select("project", "sha", "date", notes.redacted_list(notes.watches(F.col("body"))).alias("w")).filter(F.size("w") > 0)
    risks = narratives.select("project", "sha", F.posexplode("risks").alias("idx", "risk")).withColumn("risk", redact(F.col("risk")))
    sealed = F.to_date("date")
    rows = watched.join(risks, ["project", "sha"]).filter(F.array_contains("w", F.col("risk"))).select(
        F.concat_ws(":", "sha", F.col("idx").cast("string")).alias("capsule_id"), "project", "sha", "risk",
        sealed.alias("sealed_date"), F.date_add(sealed, days).alias("open_date"))
    return rows if short_window else rows.filter("open_date > sealed_date")


def insert_new(existing: DataFrame, sealed: DataFrame) -> DataFrame:
    """Rows to append: ids that exist already keep their state."""
    return sealed.join(existing.select("capsule_id"), "capsule_id", "left_anti")


def due(capsules: DataFrame, today: date, limit: int | None = K.CAPSULE_DAILY_LIMIT) -> DataFrame:
    """Capsules to open on ``today``: due and unopened, the longest due first, ``limit`` per project and day
    (those opened earlier that day count); no limit on a replay."""
    waiting = capsules.filter(F.col("opened_date").isNull() & (F.col("open_date") <= F.lit(today)))
    if limit is None:
        return waiting
    first = top_n(waiting, ["project"], [F.col("open_date"), F.col("capsule_id")], limit)
    opened = capsules.filter(F.col("opened_date") == F.lit(today)).groupBy("project").agg(F.count(F.lit(1)).alias("_already"))
    budget = F.greatest(F.lit(0), F.lit(limit) - F.coalesce("_already", F.lit(0)))
    return first.join(opened, "project", "left").filter(F.col("rank") <= budget).drop("_already", "rank")


def pending(capsules: DataFrame) -> DataFrame:
    return capsules.filter(F.col("opened_date").isNotNull() & F.col("outcome").isNull())


def pending_counts(capsules: DataFrame) -> DataFrame:
    return pending(capsules).groupBy("project").agg(F.count(F.lit(1)).alias("pending"))


def pending_fold(capsules: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` longest open predictions of each project and the number folded away."""
    shown = top_n(pending(capsules), ["project"], [F.col("open_date"), F.col("capsule_id")], n)
    return shown.join(pending_counts(capsules), "project").withColumn(
        "folded", F.greatest(F.col("pending") - n, F.lit(0)))


def fill_rate(capsules: DataFrame) -> DataFrame:
    """Opened and answered capsules per project, and one total row (``project`` NULL)."""
    return capsules.rollup("project").agg(
        F.count("opened_date").alias("opened"),
        F.count_if(F.col("opened_date").isNotNull() & F.col("outcome").isNotNull()).alias("filled"))


def answer(capsules: DataFrame, answers: DataFrame) -> DataFrame:
    """Write answers (capsule_id, project, outcome) of the known four kinds; an answer from another project is not applied."""
    valid = answers.filter(F.col("outcome").isin(*K.CAPSULE_OUTCOMES)).groupBy("capsule_id", "project").agg(
        F.max("outcome").alias("_answer"))
    return capsules.join(valid, ["capsule_id", "project"], "left").withColumn(
        "outcome", F.coalesce("_answer", "outcome")).drop("_answer")


def read_back(reports: DataFrame) -> DataFrame:
    """Answers ticked in daily reports (project, day, text).

    Within one report a marker line names the capsule and the next ticked box answers it; later boxes of that
    capsule are ignored.  A report is one file, so its lines are folded in place, without a shuffle.
    """
    start = F.struct(F.lit("").alias("pending"), F.array().cast("array<struct<capsule_id:string,outcome:string>>").alias("found"))

    def step(state, line):
        text = F.trim(line)
        marker = F.startswith(text, F.lit(K.CAPSULE_MARKER))
        ticked = F.replace(text, F.lit("[X]"), F.lit("[x]"))
        tick = (state["pending"] != "") & F.contains(ticked, F.lit("[x]"))
        outcome = F.coalesce(*[F.when(F.contains(ticked, F.lit(f"[x] {o}")), F.lit(o)) for o in K.CAPSULE_OUTCOMES])
        name = F.regexp_replace(F.substr(text, F.lit(len(K.CAPSULE_MARKER) + 1)), "[ >-]+$", "")
        answered = F.array(F.struct(state["pending"].alias("capsule_id"), outcome.alias("outcome")))
        return F.struct(
            F.when(marker, name).when(tick, F.lit("")).otherwise(state["pending"]).alias("pending"),
            F.when(~marker & tick & outcome.isNotNull(), F.concat(state["found"], answered)).otherwise(state["found"]).alias("found"))

    found = F.aggregate(lines(F.col("text")), start, step, lambda s: s["found"])
    rows = reports.select("project", "day", F.posexplode(found).alias("pos", "a"))
    # a later report, and a later line within it, has the last word
    return rows.groupBy("project", F.col("a.capsule_id").alias("capsule_id")).agg(
        F.max_by(F.col("a.outcome"), F.struct("day", "pos")).alias("outcome"))


def verbatim(capsules: DataFrame, commits: DataFrame) -> DataFrame:
    """Add ``kind``: ``watch`` when the risk repeats a watch note of its commit, ``predicted`` when it does not,
    ``unknown`` when the commit is not there."""
    bodies = commits.select("project", "sha", notes.redacted_list(notes.watches(F.col("body"))).alias("_w"))
    return capsules.join(bodies, ["project", "sha"], "left").withColumn(
        "kind",
        F.when(F.col("_w").isNull(), "unknown").when(F.array_contains("_w", redact(F.col("risk"))), "watch").otherwise("predicted"),
    ).drop("_w")


def clean_up(capsules: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows to keep: watch notes, and everything whose commit cannot be seen."""
    return verbatim(capsules, commits).filter("kind <> 'predicted'")


def watch_inbox(capsules: DataFrame, commits: DataFrame, today: date) -> DataFrame:
    """All unanswered predictions with what is needed to order them: projects by ``pending`` descending, then
    ``kind`` = watch first, then the longest open."""
    rows = verbatim(pending(capsules), commits)
    rates = capsules.groupBy("project").agg(
        F.count("opened_date").alias("opened"),
        F.count_if(F.col("opened_date").isNotNull() & F.col("outcome").isNotNull()).alias("filled"))
    return rows.join(rates, "project").join(pending_counts(capsules), "project").select(
        "project", "capsule_id", F.substring("sha", 1, 7).alias("sha7"), redact(F.col("risk")).alias("risk"),
        (F.col("kind") == "watch").alias("verbatim"), F.datediff(F.lit(today), F.col("sealed_date")).alias("days_sealed"),
        "open_date", "pending", "opened", "filled")


