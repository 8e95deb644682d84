"""Deterministic text blocks for commits, evidence and review cards.  All take columns of the current row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions import notes
from whylake.functions.redact import redact


def labelled(label: str, items: Column, indent: str = "  ") -> Column:
    """One line per item behind a label; NULL when there is none, so that concat_ws skips it."""
    return F.when(F.size(items) > 0, F.concat(F.lit(indent + label), F.array_join(items, f"\n{indent}{label}")))


def render_hit() -> Column:
    """A search hit: short SHA, why, decisions and rejected paths; a turn is shown as talk."""
    commit = F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.substring("sha", 1, 7), F.lit("]")),
        F.when(F.col("why") != "", F.concat(F.lit("  " + K.L_WHY), F.col("why"))),
        labelled(K.L_DECISION, F.col("decisions")), labelled(K.L_REJECTED, F.col("rejected")))
    return F.when(F.col("kind") == "conversation", F.concat(F.lit("[你的讨论] "), F.col("text"))).otherwise(commit)


def verbatim_text() -> Column:
    """Only recorded words, without labels, for matching quotes."""
    return F.concat_ws(
        "\n", F.when(F.size("decisions") > 0, F.array_join("decisions", "\n")),
        F.when(F.size("rejected") > 0, F.array_join("rejected", "\n")), F.nullif("why", F.lit("")))


def cited_sources() -> Column:
    """Where a citation leads: a commit, or the id of a recorded turn."""
    return F.when(F.col("kind") == "conversation", F.concat(F.lit("session:"), F.col("sha"))).otherwise(
        F.concat(F.lit("commit:"), F.substring("sha", 1, 12)))


def segment_block() -> Column:
    """A commit of a line history with everything known about it."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.substring("sha", 1, 7), F.lit("] "), F.date_format("date", "yyyy-MM-dd"), F.lit(" "), F.col("subject")),
        F.when(F.col("why") != "", F.concat(F.lit("  " + K.L_WHY), F.col("why"))),
        labelled(K.L_DECISION, F.col("decisions")), labelled(K.L_REJECTED, F.col("rejected")), labelled(K.L_RISK, F.col("risks")))


def context_line() -> Column:
    """The same commit on one line with bounded excerpts."""
    cut = lambda c: F.substring(c, 1, K.ASK_EXCERPT)
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), cut(F.array_join(c, ";"))))
    return F.concat_ws(
        " / ",
        F.concat(F.lit("["), F.substring("sha", 1, 7), F.lit("]"), F.when(F.col("subject") != "", F.concat(F.lit(" "), "subject")).otherwise("")),
        F.when(F.col("why") != "", F.concat(F.lit(K.L_WHY), cut(F.col("why")))),
        part(K.L_DECISION, F.col("decisions")), part(K.C_REJECTED, F.col("rejected")), part(K.C_RISKS, F.col("risks")))


def evidence_block(evidence: Column) -> Column:
    """Session anchors with their quotes, and a warning when none of them is a strong match."""
    head = lambda e: F.concat(
        F.lit("- ["), F.coalesce(e["source"], F.lit("?")), F.lit("·"), F.substring(F.coalesce(e["session_id"], F.lit("")), 1, 7),
        F.lit("·"), F.coalesce(e["ts"].cast("string"), F.lit("")), F.lit("·"), F.coalesce(e["confidence"], F.lit("?")), F.lit("]"))
    lines = F.transform(evidence, lambda e: F.concat_ws(
        "\n", head(e), labelled("原话:", notes.texts_or_empty(e["prompts"])), labelled("AI:", notes.texts_or_empty(e["excerpts"]))))
    weak = ~F.exists(evidence, lambda e: e["confidence"] == "high")
    return F.when(F.size(evidence) > 0, F.concat_ws(
        "\n", F.lit(K.EVIDENCE_TITLE), F.array_join(lines, "\n"), F.when(weak, F.lit(K.EVIDENCE_LOW_WARN))))


def tests_block(tests: Column) -> Column:
    lines = F.transform(tests, lambda t: F.concat(
        F.lit("- "), t["path"], F.lit(" — "), F.when(F.size(t["names"]) > 0, F.array_join(t["names"], "、")).otherwise(K.NO_TEST_NAMES)))
    return F.when(F.size(tests) > 0, F.concat(F.lit(K.TEST_REFS_TITLE + "\n"), F.array_join(lines, "\n")))


def requests_block(requests: Column) -> Column:
    lines = F.transform(requests, lambda p: F.concat(
        F.lit("- #"), p["number"].cast("string"), F.lit(" "), F.coalesce(p["title"], F.lit("")), F.lit(" — "), F.coalesce(p["snippet"], F.lit(""))))
    return F.when(F.size(requests) > 0, F.concat(F.lit(K.PR_REFS_TITLE + "\n"), F.array_join(lines, "\n")))


def references(separator: str = "\n") -> Column:
    """Evidence, test and request blocks of a row that carries them (evidence, test_refs, pr_refs)."""
    return F.concat_ws(separator, evidence_block(F.col("evidence")), tests_block(F.col("test_refs")), requests_block(F.col("pr_refs")))


def hit_with_references() -> Column:
    """A hit with its anchors, indented below the commit."""
    blocks = [
        F.concat(F.lit("  "), F.replace(block, F.lit("\n"), F.lit("\n  ")))
        for block in (evidence_block(F.col("evidence")), tests_block(F.col("test_refs")), requests_block(F.col("pr_refs")))]
    return F.when(F.col("kind") == "conversation", render_hit()).otherwise(F.concat_ws("\n", render_hit(), *blocks))


def card_text() -> Column:
    """A review card as text: records first, generated text marked as no evidence, how exact the lines are, and that a
    person has to judge."""
    span = F.concat(F.lit(" · "), F.col("file"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    title = (
        F.when(F.col("kind") == "potential_conflict", "潜在决策冲突").when(F.col("kind") == "decision_context", "决策上下文")
        .otherwise("未找到决策证据"))
    summary = F.when(F.col("interpretation.summary") != "", F.concat(F.lit("  生成解释(非证据):"), "interpretation.summary"))
    source = F.when(F.col("primary_sha").isNotNull(), F.concat(
        F.lit("  来源:["), F.substring("primary_sha", 1, 7), F.lit("] "), F.date_format("primary_date", "yyyy-MM-dd"), F.lit(" "),
        F.col("primary_subject"), F.lit(" · commit 触达")))
    return F.concat_ws(
        "\n", F.concat(F.lit("["), F.col("card_id"), F.lit("] "), title, span),
        labelled(K.L_REJECTED, F.col("rejected")), labelled(K.L_DECISION, F.col("chosen")), summary,
        labelled("生成解释·否决路径(非证据):", F.col("interpretation.rejected")),
        labelled("生成解释·决策(非证据):", F.col("interpretation.decisions")), source,
        F.concat(F.lit("  "), "label"), F.lit("  关联只来自 git 历史,未做语义判定;需要人工判断。"))


def user_message(question: Column, history: Column, material: Column) -> Column:
    """What a model would be asked: earlier turns to understand the question, records to answer from, redacted as a whole."""
    return redact(F.concat_ws(
        "\n\n",
        F.when(history != "", F.concat(F.lit("对话历史(仅供理解追问意图,不得作事实依据):\n"), history)),
        F.concat(F.lit("材料(真实记录,旧→新;只据此回答):\n"), F.coalesce(F.nullif(material, F.lit("")), F.lit("(无相关记录)"))),
        F.concat(F.lit("问题:"), question)))


def debt_bar(debt: Column, peak: Column) -> Column:
    """One to five blocks in proportion to the largest debt."""
    size = F.greatest(F.lit(1), F.bround(F.coalesce(F.try_divide(debt, peak), F.lit(0.0)) * 5)).cast("int")
    return F.repeat(F.lit("█"), size)
