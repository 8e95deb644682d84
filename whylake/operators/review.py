"""Decision review cards: every hunk of a pending diff with the recorded decisions behind its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions.redact import redact
from whylake.functions.text import LINE_BREAK, card_id, let
from whylake.operators.history import line_history
from whylake.operators.ranking import sieved, top_n
from whylake.session import written

COMMIT = ["project", "sha"]


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """Unified diffs (diff_id, text) to hunks: file, new line range, text, in order.

    Everything is local to the row of a diff: it is split into the sections of its files, and these into pieces that begin with a
    hunk's header.  Deleted files, empty ranges and unreadable headers give no hunk; any line starting with "+++ " switches
    the file, and what follows without a file belongs to the hunk before.
    """
    text = F.regexp_replace(F.regexp_replace("text", f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK, "\n")
    sections = F.split(text, r"(?md)^(?=diff --git )")

    def switched(piece: Column) -> Column:
        """The file that the last line with a name in a piece switches to; null without such a line."""
        path = F.trim(F.try_element_at(F.regexp_extract_all(piece, F.lit(r"(?md)^\+\+\+ (.*)$"), F.lit(1)), F.lit(-1)))
        return F.when(path == "/dev/null", "").otherwise(F.regexp_replace(path, "^b/", ""))

    def of_section(pieces: Column) -> Column:
        switches = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("at"), switched(p).alias("file"))), lambda s: s["file"].isNotNull())

        def begun(switches: Column) -> Column:
            file = lambda i: F.coalesce(F.try_element_at(F.filter(switches, lambda s: s["at"] < i), F.lit(-1))["file"], F.lit(""))
            each = F.transform(pieces, lambda p, i: F.struct(i.alias("at"), file(i).alias("file"), p.alias("piece")))
            return F.filter(each, lambda x: F.startswith(x["piece"], F.lit("@@")) & (x["file"] != ""))

        def whole(starts: Column) -> Column:
            end = lambda j: F.coalesce(F.get(starts, j + 1)["at"], F.size(pieces))
            body = lambda x, j: F.array_join(F.slice(pieces, x["at"] + 1, end(j) - x["at"]), "")
            told = lambda x, j: F.regexp_replace(F.regexp_replace(body(x, j), r"(?md)^\+\+\+ .*(?:\n|\z)", ""), r"\n\z", "")
            return F.transform(starts, lambda x, j: F.struct(x["file"].alias("file"), F.substring_index(x["piece"], "\n", 1).alias("header"), told(x, j).alias("diff")))

        return let(let(switches, begun), whole)

    found = F.flatten(F.transform(sections, lambda s: let(F.split(s, r"(?md)^(?=@@)"), of_section)))

    def ranged(h: Column) -> Column:
        part = lambda n: F.nullif(F.regexp_extract(h["header"], K.HUNK_PATTERN, n), F.lit("")).cast("bigint")
        return F.struct(h["file"].alias("file"), part(1).alias("start"), F.coalesce(part(2), F.lit(1)).alias("count"), h["diff"].alias("diff"))

    good = F.filter(F.transform(F.filter(found, lambda h: F.regexp_like(h["header"], F.lit(K.HUNK_PATTERN))), ranged), lambda h: h["count"] > 0)
    rows = diffs.select("diff_id", F.posexplode(good).alias("no", "h"))
    return rows.select("diff_id", (F.col("no") + 1).alias("hunk_no"), "h.file", "h.start", (F.col("h.start") + F.col("h.count") - 1).alias("end"), "h.diff")


def cap_hunks(hunks: DataFrame, limit: int = K.MAX_REVIEW_HUNKS) -> DataFrame:
    """The first hunks of every diff are analysed; the totals say when there were more."""
    totals = hunks.groupBy("diff_id").agg(F.count(F.lit(1)).alias("total_hunks"))
    return top_n(hunks, ["diff_id"], [F.col("hunk_no")], limit, "_n").drop("_n").join(totals, "diff_id").withColumn(
        "truncated", F.col("total_hunks") > limit)


def history_of(targets: DataFrame, hunks: DataFrame, files: DataFrame, limit: int = K.HISTORY_LIMIT) -> DataFrame:
    """Commits behind each target (target_id, project, file, start, end, line_known, own_pos), newest first.

    Where line data exists they are the earlier commits that made the target's lines what they are, each found where
    the lines were at its time; otherwise the earlier commits of the file.
    """
    targets = written(targets)
    by_line = line_history(targets.filter("line_known"), hunks, limit=limit).select("target_id", "project", "sha", "log_pos")
    whole = targets.filter("NOT line_known").select("target_id", "project", "file", "own_pos")
    by_file = whole.join(sieved(files.select("project", "file", "sha", "log_pos"), ["project", "file"], whole), ["project", "file"]).filter("log_pos < own_pos").select(
        "target_id", "project", "sha", "log_pos")
    return top_n(by_line.unionByName(by_file), ["target_id"], [F.col("log_pos").desc()], limit)


def precision_label(precision: Column, sourced: Column, explained: Column, n: Column) -> Column:
    badge = F.coalesce(*[F.when(precision == k, F.lit(v)) for k, v in K.PRECISION_BADGE.items()])
    base = F.coalesce(*[F.when(precision == k, F.lit(v)) for k, v in K.PRECISION_TEXT.items()])
    detail = (
        F.when(sourced, "有据(人工决策/可核验来源)").when(explained, "仅生成解释(非证据)")
        .when(n > 0, "仅提交记录(无叙事/决策记录)").otherwise("无历史记录"))
    return F.concat(badge, F.lit(" 溯源精度:"), base, F.lit(" · "), detail)


def evidence_type(rejected: Column, decided: Column, sourced: Column, known: Column) -> Column:
    return (
        F.when(rejected, "authored_rejected_path").when(decided, "authored_decision").when(sourced, "source_reference")
        .when(known, "commit_history").otherwise("none"))


def review_cards(targets: DataFrame, history: DataFrame, segments: DataFrame) -> DataFrame:
    """One card per target.

    The primary record is the newest commit with an authored rejected path, else the newest with an authored decision,
    else the newest that explains itself, else the newest.  Evidence, tests and requests are sources.  Generated text never makes a conflict and never counts as
    evidence; it stays in its own columns.
    """
    if "n_refs" not in segments.columns:
        segments = segments.withColumn("n_refs", F.lit(0))
    rows = history.drop("rank").join(segments.withColumn("_sources", F.col("n_evidence") + F.col("n_refs")).drop("log_pos"), COMMIT)
    rejected, decided = F.size("authored_rejected") > 0, F.size("authored_decisions") > 0
    tier = F.when(rejected, 0).when(decided, 1).when(F.col("has_why"), 2).otherwise(3)
    sourced = rejected | decided | (F.col("_sources") > 0)
    record = F.struct(
        "sha", "date", "subject", "why", "authored_decisions", "authored_rejected", "generated_decisions", "generated_rejected",
        "n_evidence", "_sources", "has_why")
    judged = rows.groupBy("target_id").agg(
        F.min_by(record, F.struct(tier, -F.col("log_pos"))).alias("p"), F.count(F.lit(1)).alias("n"),
        F.bool_or(sourced).alias("sourced"), F.bool_or("has_why").alias("explained"))
    cards = targets.join(judged, "target_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    false = lambda c: F.coalesce(c, F.lit(False))
    has_rejected, has_decided = false(F.size("p.authored_rejected") > 0), false(F.size("p.authored_decisions") > 0)
    precision = F.when(F.col("n") == 0, "none").when(F.col("line_known"), "line").otherwise("file")
    kind = F.when(has_rejected, "potential_conflict").when(false(F.col("p.has_why")), "decision_context").otherwise("no_evidence")
    generated = false(
        (F.trim("p.why") != "") | (F.size("p.generated_decisions") > 0) | (F.size("p.generated_rejected") > 0))
    span = F.concat(F.col("file"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    reason = F.when(precision == "none", F.concat(
        F.lit("Current diff hunk "), span, F.lit(" has no recoverable Git history; semantic applicability cannot be evaluated."))).otherwise(F.concat(
            F.lit("Current diff hunk "), span, F.lit(" maps to Git history for its changed range; semantic applicability is not evaluated.")))
    redacted = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), redact)
    return cards.select(
        "target_id", "project", "file", "start", "end",
        card_id(F.col("file"), F.col("start"), F.col("end"), F.coalesce("p.sha", F.lit("no-history")),
                F.array_join(F.coalesce("p.authored_rejected", F.array().cast("array<string>")), "\n")).alias("card_id"),
        kind.alias("kind"), precision.alias("precision"),
        precision_label(precision, false(F.col("sourced")), false(F.col("explained")), F.col("n")).alias("label"),
        reason.alias("reason"), F.lit("not_evaluated").alias("semantic_match"),
        F.col("p.sha").alias("primary_sha"), F.col("p.date").alias("primary_date"), redact(F.col("p.subject")).alias("primary_subject"),
        redacted(F.col("p.authored_decisions")).alias("chosen"), redacted(F.col("p.authored_rejected")).alias("rejected"),
        evidence_type(has_rejected, has_decided, false(F.col("p._sources") > 0), F.col("p.sha").isNotNull()).alias("evidence_type"),
        F.greatest(F.col("n") - 1, F.lit(0)).alias("supporting"),
        F.when(generated, F.struct(
            F.lit("generated_interpretation").alias("label"), F.lit(False).alias("authoritative"), redact(F.trim("p.why")).alias("summary"),
            redacted(F.col("p.generated_decisions")).alias("decisions"), redacted(F.col("p.generated_rejected")).alias("rejected"))).alias("interpretation"),
        F.when(has_rejected, "unresolved").alias("judgment"),
        F.when(kind == "potential_conflict", 0).when(kind == "decision_context", 1).otherwise(2).alias("order_kind"),
        F.when(precision == "line", 0).when(precision == "file", 1).otherwise(2).alias("order_precision"))


def supporting_records(history: DataFrame, cards: DataFrame, segments: DataFrame) -> DataFrame:
    """The other commits behind a card, as rows."""
    rest = history.join(cards.select("target_id", "card_id", "primary_sha"), "target_id").filter("sha <> primary_sha")
    return rest.drop("rank").join(segments.drop("log_pos", "date"), COMMIT).drop("primary_sha")


def valid_feedback(judgments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judgements fit for export, reduced to an allow-list of columns, and the rejected rows with the reason.

    ``judgments`` is (judgment_id, status, action_changed, elapsed_seconds, evidence_type, precision, comment)."""
    confirmed = F.col("status") == K.JUDGMENT_OUTCOMES[0]
    elapsed = F.col("elapsed_seconds")
    reason = (
        F.when(F.col("status").isNull() | ~F.col("status").isin(*K.JUDGMENT_OUTCOMES), "unresolved judgment")
        .when(confirmed & F.col("action_changed").isNull(), "action change is required")
        .when(~confirmed & F.col("action_changed").isNotNull(), "invalid action change")
        .when(elapsed.isNull() | F.isnan(elapsed) | (elapsed < 0) | (elapsed > 86400), "invalid elapsed time"))
    checked = judgments.withColumn("reason", reason)
    good = checked.filter("reason IS NULL").select(
        "judgment_id", F.lit(1).alias("schema_version"), F.col("status").alias("judgment"), "action_changed", "evidence_type",
        F.when(F.col("precision").isin("line", "file", "none"), F.col("precision")).otherwise("none").alias("provenance_precision"),
        F.bround("elapsed_seconds", 1).alias("elapsed_review_seconds"),
        (confirmed & F.coalesce("action_changed", F.lit(False))).alias("verified_interception"),
        F.nullif(F.substring(redact(F.trim("comment")), 1, 500), F.lit("")).alias("approved_comment"))
    return good, checked.filter("reason IS NOT NULL").select("judgment_id", "reason")
