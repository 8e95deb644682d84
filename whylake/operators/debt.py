"""Understanding debt: how much was decided in a file since somebody last looked at it.

Inputs, all keyed by (project, sha): ``files`` (project, sha, log_pos, date, file), ``narratives`` (decisions),
``capsules`` (capsule_id, opened_date, outcome), ``reviewed`` (reviewed_at); and ``tracked`` (project, file) or None.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.operators.ranking import top_n


def commit_signals(narratives: DataFrame, capsules: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Everything known about a commit besides its files, one row per (project, sha).

    Capsules are counted here, before any join with files, so they are not multiplied.  All three inputs are small
    next to the files; they are stacked and reduced in one shuffle rather than joined one after the other.
    """
    decided = narratives.select(
        "project", "sha", F.size("decisions").cast("bigint").alias("n_dec"),
        F.get("decisions", F.lit(0)).alias("first_dec"), F.lit(0).cast("bigint").alias("cap"),
        F.lit(0).cast("bigint").alias("filled"), F.lit(None).cast("date").alias("review_day"))
    caps = capsules.select(
        "project", "sha", F.lit(0).cast("bigint").alias("n_dec"), F.lit(None).cast("string").alias("first_dec"),
        F.lit(1).cast("bigint").alias("cap"), F.col("outcome").isNotNull().cast("bigint").alias("filled"),
        F.lit(None).cast("date").alias("review_day"))
    looks = reviewed.select(
        "project", "sha", F.lit(0).cast("bigint").alias("n_dec"), F.lit(None).cast("string").alias("first_dec"),
        F.lit(0).cast("bigint").alias("cap"), F.lit(0).cast("bigint").alias("filled"),
        F.to_date("reviewed_at").alias("review_day"))
    return decided.unionByName(caps).unionByName(looks).groupBy("project", "sha").agg(
        F.sum("n_dec").alias("n_dec"), F.max("first_dec").alias("first_dec"), F.sum("cap").alias("caps"),
        F.sum("filled").alias("filled"), F.max("review_day").alias("review_day"))


def keep_tracked(rows: DataFrame, tracked: DataFrame | None) -> DataFrame:
    """Drop files that are gone.  A project without a snapshot keeps all of its files."""
    if tracked is None:
        return rows
    marked = rows.join(tracked.select("project", "file", F.lit(True).alias("_kept")), ["project", "file"], "left")
    known = tracked.select("project").distinct().withColumn("_known", F.lit(True))
    return marked.join(known, "project", "left").filter(
        F.col("_kept").isNotNull() | F.col("_known").isNull()).drop("_kept", "_known")


def debt_board(
    files: DataFrame, narratives: DataFrame, capsules: DataFrame, reviewed: DataFrame,
    tracked: DataFrame | None, today: date,
) -> DataFrame:
    signals = commit_signals(narratives, capsules, reviewed)
    touched = files.join(signals, ["project", "sha"], "left")
    board = touched.groupBy("project", "file").agg(
        F.sum(F.coalesce("n_dec", F.lit(0)) + 1).alias("churn"),
        F.count(F.lit(1)).alias("commits"),
        F.count("review_day").alias("reviewed"),
        F.sum(F.coalesce("caps", F.lit(0))).alias("caps_total"),
        F.sum(F.coalesce("filled", F.lit(0))).alias("caps_filled"),
        F.max("review_day").alias("_review"),
        F.max(F.to_date("date")).alias("_touch"),
        # newest touch; the earlier commit in log order wins a tie, as the log is read forwards
        F.max_by(F.coalesce("first_dec", F.lit("")), F.struct("date", -F.col("log_pos"))).alias("last_decision"),
    )
    board = keep_tracked(board, tracked)
    denominator = F.col("commits") + F.col("caps_total")
    understand = F.coalesce(F.try_divide((F.col("reviewed") + F.col("caps_filled")).cast("double"), denominator), F.lit(0.0))
    age = F.datediff(F.lit(today), F.coalesce("_review", "_touch"))
    decay = 1 + F.greatest(F.lit(0), age) / F.lit(float(K.DECAY_DAYS))
    exact = F.col("churn") * decay * (1 - understand)
    # six digits, so that debts equal but for the order of their operations tie, and the file's name decides
    return board.select(
        "project", "file", F.bround(exact, 1).alias("debt"), F.round(exact, 6).alias("debt_exact"), "churn", "reviewed", "commits",
        "caps_filled", "caps_total", F.nullif("last_decision", F.lit("")).alias("last_decision"))


def debt_top(board: DataFrame, n: int) -> DataFrame:
    return top_n(board, ["project"], [F.col("debt_exact").desc(), F.col("file")], n)


def debt_drilldown(
    commits: DataFrame, files: DataFrame, narratives: DataFrame, capsules: DataFrame, reviewed: DataFrame,
    tracked: DataFrame | None,
) -> DataFrame:
    """What a file's debt is made of, one row per item: decision commits nobody re-read, and predictions that are
    due but unanswered."""
    keys = ["project", "sha"]
    decided = narratives.filter(F.size("decisions") > 0).select(*keys, F.array_join("decisions", " | ").alias("detail"))
    unread = decided.join(reviewed.select(*keys), keys, "left_anti").join(commits.select(*keys, "subject"), keys)
    pending = capsules.filter(F.col("opened_date").isNotNull() & F.col("outcome").isNull())
    items = unread.select(*keys, F.lit("unreviewed").alias("kind"), F.col("subject").alias("item"), "detail").unionByName(
        pending.select(*keys, F.lit("pending_capsule").alias("kind"), F.col("capsule_id").alias("item"),
                       F.col("risk").alias("detail")))
    rows = files.select(*keys, "file").join(items, keys)
    return keep_tracked(rows, tracked).select("project", "file", "kind", "sha", "item", "detail")
