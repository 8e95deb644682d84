"""Daily digests, briefs and the other reading views, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions import notes
from whylake.functions.redact import SECRET_NAMES, redact, with_redaction_counts
from whylake.functions.text import first_sentence, neutral_markdown, note_folder
from whylake.operators import capsules as CAP
from whylake.operators import coverage as COV
from whylake.operators.ranking import first_texts, left_few, sieved, top_n, without_few
from whylake.session import cut_lineage, written

COMMIT = ["project", "sha"]


# --- days -----------------------------------------------------------------------

def daily_digests(commits: DataFrame, narratives: DataFrame) -> DataFrame:
    """One row per project and day: the overview that needs no model (count and the first three subjects) and the
    first decision of the day."""
    rows = left_few(
        commits.select(*COMMIT, "log_pos", "subject", F.to_date("date").alias("day")),
        narratives.select(*COMMIT, F.get("decisions", F.lit(0)).alias("decision")), COMMIT)
    has = F.col("decision").isNotNull()
    day = rows.groupBy("project", "day").agg(
        F.count(F.lit(1)).alias("commits"),
        F.min_by(F.when(has, F.col("decision")), F.when(has, F.col("log_pos"))).alias("decision"))
    first = top_n(rows.select("project", "day", "log_pos", "subject"), ["project", "day"], [F.col("log_pos")], 3)
    subjects = first.groupBy("project", "day").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "subject"))), lambda x: x["subject"]), ";").alias("s"))
    return day.join(subjects, ["project", "day"]).select(
        "project", "day", "commits",
        redact(F.concat(F.lit("今日 "), F.col("commits").cast("string"), F.lit(" 个 commit:"), F.col("s"))).alias("overview"),
        redact(F.coalesce("decision", F.lit(""))).alias("decision"))


def daily_stats(commits: DataFrame, cached: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Commits per project and day, how many had a narrative before the run, and how many needed one.
    ``usage`` (project, day, tokens_in, tokens_out) adds token sums where given."""
    rows = left_few(commits.select(*COMMIT, F.to_date("date").alias("day")), cached.select(*COMMIT, F.lit(1).alias("_hit")), COMMIT)
    out = rows.groupBy("project", "day").agg(F.count(F.lit(1)).alias("commits"), F.count("_hit").alias("cache_hits"))
    out = out.withColumn("llm_calls", F.col("commits") - F.col("cache_hits"))
    return out if usage is None else out.join(usage, ["project", "day"], "left")


def on_this_day(digests: DataFrame) -> DataFrame:
    """The same calendar day one month and one year back (clamped to the month's end), first sentence only."""
    past = digests.select("project", F.col("day").alias("past_day"), first_sentence(F.col("overview")).alias("sentence"))
    back = digests.select("project", "day", F.explode(F.array(
        F.struct(F.lit(K.LAST_MONTH).alias("label"), F.add_months("day", -1).alias("past_day")),
        F.struct(F.lit(K.LAST_YEAR).alias("label"), F.add_months("day", -12).alias("past_day")))).alias("b")).select("project", "day", "b.*")
    return back.join(past, ["project", "past_day"]).filter("sentence <> ''").select("project", "day", "label", "past_day", "sentence")


def latest_daily(digests: DataFrame) -> DataFrame:
    return digests.groupBy("project").agg(F.max_by(F.struct("day", "overview", "decision"), "day").alias("d")).select("project", "d.*")


def overview_rows(commits: DataFrame, narratives: DataFrame) -> DataFrame:
    """One listing line per commit."""
    joined = commits.join(narratives.select(*COMMIT, "what", "decisions"), COMMIT, "left")
    line = F.concat(
        F.lit("- "), F.substring("sha", 1, 8), F.lit(" "), F.col("subject"), F.lit("|what: "),
        F.substring(F.coalesce("what", F.lit("")), 1, 150), F.lit("|decisions: "),
        F.substring(F.array_join(notes.texts_or_empty(F.col("decisions")), "; "), 1, 200))
    return joined.select("project", "sha", "log_pos", F.to_date("date").alias("day"), line.alias("line"))


def char_budget(rows: DataFrame, keys: list[str], budget: int = K.OVERVIEW_BUDGET) -> DataFrame:
    """Lines kept in order while they fit the budget (a newline counts one), and the number left out.

    Lengths are summed per day first; the small table of days is summed up, and lines are summed inside their day only,
    so that no group is sorted in one task.
    """
    sized = rows.withColumns({"_day": F.coalesce("day", F.lit("0001-01-01").cast("date")), "_size": F.length("line").cast("bigint") + 1})
    days = sized.groupBy(*keys, "_day").agg(F.sum("_size").alias("_all"))
    before = W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    offsets = days.select(*keys, "_day", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_offset"))
    running = W.partitionBy(*keys, "_day").orderBy("log_pos", "sha").rowsBetween(W.unboundedPreceding, 0)
    used = sized.withColumn("_inside", F.sum("_size").over(running)).join(offsets, [*keys, "_day"]).select(
        *keys, (F.col("_offset") + F.col("_inside") - 1).alias("used"))
    fits = F.col("used") <= budget
    return used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(fits).alias("kept"), F.count_if(~fits).alias("omitted"),
        F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0)).alias("used"))


def report_lines(commits: DataFrame, narratives: DataFrame, digests: DataFrame, capsules: DataFrame) -> DataFrame:
    """The daily report as ordered lines (project, day, section, log_pos, part, line), so that a busy day is as many
    rows, never one growing text.  Write with ``sinks.write_report_lines``."""
    head = digests.select("project", "day", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("# "), F.col("day").cast("string"), F.lit(" "), F.element_at(F.split("project", "/"), -1), F.lit(" 开发日报")).alias("line")),
        F.struct(F.lit(1).alias("part"), F.lit("## 今日概览").alias("line")),
        F.struct(F.lit(2).alias("part"), F.col("overview").alias("line")),
        F.struct(F.lit(3).alias("part"), F.when(F.col("decision") != "", F.concat(F.lit("> **今日决定** — "), "decision")).alias("line")),
    )).alias("l")).select("project", "day", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("log_pos"), "l.part", "l.line")

    opened = capsules.filter("opened_date IS NOT NULL")
    opened = opened.join(sieved(commits.select(*COMMIT, "log_pos", "subject"), COMMIT, opened), COMMIT, "left")
    sha7 = F.substring("sha", 1, 7)
    boxes = [
        F.struct(F.lit(2 + i).alias("part"), F.concat(F.lit("\t- ["), F.when(F.col("outcome") == o, "x").otherwise(" "), F.lit(f"] {o}")).alias("line"))
        for i, o in enumerate(K.CAPSULE_OUTCOMES)]
    context = F.coalesce(F.concat(F.lit("\n\t> 📌 `"), sha7, F.lit("` "), neutral_markdown(F.col("subject"))), F.lit(""))
    caps = opened.select("project", F.col("opened_date").alias("day"), F.coalesce("log_pos", F.lit(0).cast("bigint")).alias("log_pos"), F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit(K.CAPSULE_MARKER), "capsule_id", F.lit(" -->")).alias("line")),
        F.struct(F.lit(1).alias("part"), F.concat(
            F.lit("- **"), F.datediff("opened_date", "sealed_date").cast("string"), F.lit(" 天前**(`"), sha7, F.lit("`)你担心:「"), "risk",
            F.lit("」"), context).alias("line")), *boxes)).alias("l")).select(
        "project", "day", F.lit(1).alias("section"), "log_pos", "l.part", "l.line")

    told = left_few(commits, narratives.select(*COMMIT, "what", "why", "decisions", "risks", "open_loops", "degraded"), COMMIT)

    def bullets(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"**{title}**\n- "), F.array_join(items, "\n- ")))

    listed = lambda c: notes.without_filler(notes.texts_or_empty(F.col(c)))
    lines = [
        F.concat(F.lit("### `"), F.substring("sha", 1, 8), F.lit("` "), F.col("subject"), F.lit("("), F.date_format("date", "HH:mm"), F.lit(")")),
        F.when(F.coalesce("degraded", F.lit(False)), F.lit("> ⚠️ 本条为降级叙事(LLM 调用失败)")),
        F.concat(F.lit("**改了什么** "), "what"), F.concat(F.lit("**为什么** "), "why"),
        bullets("关键决策", notes.texts_or_empty(F.col("decisions"))), bullets("风险(供日后验证)", listed("risks")),
        bullets("未闭环", listed("open_loops")),
    ]
    body = told.select("project", F.to_date("date").alias("day"), "log_pos", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), line.alias("line")) for i, line in enumerate(lines)])).alias("l")).select(
        "project", "day", F.lit(2).alias("section"), "log_pos", "l.part", "l.line")
    loops = told.select("project", F.to_date("date").alias("day"), "log_pos", F.explode(listed("open_loops")).alias("loop"))
    loops = loops.groupBy("project", "day", "loop").agg(F.min("log_pos").alias("log_pos")).select(
        "project", "day", F.lit(3).alias("section"), "log_pos", F.lit(0).alias("part"), F.concat(F.lit("- "), "loop").alias("line"))
    return head.unionByName(caps).unionByName(body).unionByName(loops).filter("line IS NOT NULL").withColumn("line", redact(F.col("line")))


# --- notes and documents -------------------------------------------------------------

def session_refs(matches: DataFrame) -> DataFrame:
    """(project, sha, refs): the sessions that time and files tie to a commit, as one line; equal short ids count once."""
    high = matches.filter("confidence = 'high'").select(*COMMIT, "source", "session_id", "n_overlap")
    first = high.groupBy(*COMMIT, F.substring("session_id", 1, 8).alias("sid")).agg(F.min_by("n_overlap", F.struct("source", "session_id")).alias("n"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("sid", "n"))), lambda x: F.concat(F.lit("`"), x["sid"], F.lit("`(交集 "), x["n"].cast("string"), F.lit(" 文件)")))
    return first.groupBy(*COMMIT).agg(F.concat(F.lit("关联会话:"), F.array_join(told, "、")).alias("refs"))


def report_document(commits: DataFrame, narratives: DataFrame, capsules: DataFrame, sessions: DataFrame, matches: DataFrame) -> DataFrame:
    """The whole daily report as ordered lines: title, the same day in the past, overview, opened capsules, narratives with their
    aligned sessions, open ends or that there are none, and a footer with the counts of the day.

    Lines (project, day, section, log_pos, part, line), as ``sinks.write_report_lines`` takes them."""
    narratives = written(narratives.select(*COMMIT, "what", "why", "decisions", "risks", "open_loops", "degraded"))
    digests = written(daily_digests(commits, narratives))
    day_of = F.to_date("date")
    # an opened capsule alone makes no report; every other line is of a commit, so of a day that has one
    begun_on = digests.select("project", F.col("day").alias("opened_date"))
    opened = written(capsules.join(begun_on, ["project", "opened_date"], "left_semi"))
    rows = report_lines(commits, narratives, digests, opened).filter("project IS NOT NULL AND day IS NOT NULL")
    section = F.when(F.col("section") == 0, F.when(F.col("part") == 0, 0).otherwise(2)).otherwise(F.col("section") + 2)
    rows = rows.withColumn("section", section)

    def lines(df: DataFrame, section: int, log_pos: Column, part: Column, line: Column) -> DataFrame:
        return df.select("project", "day", F.lit(section).alias("section"), log_pos.cast("bigint").alias("log_pos"), part.cast("int").alias("part"), line.alias("line"))

    first, zero = F.lit(-1), F.lit(0)
    past = lines(on_this_day(digests), 1, zero, F.when(F.col("label") == K.LAST_MONTH, 0).otherwise(1), F.concat(
        F.lit("> 📮 **"), "label", F.lit("** · "), F.col("past_day").cast("string"), F.lit(":「"), "sentence", F.lit("。」")))
    days = digests.select("project", "day")
    told = lines(days, 4, first, zero, F.lit("## 变更叙事"))
    ends = lines(days, 5, first, zero, F.lit("## 未闭环汇总"))
    marked = lines(opened.select("project", F.col("opened_date").alias("day")).distinct(), 3, first, zero, F.lit("## 🕰 今日开启的时间胶囊"))
    left_open = written(rows.filter("section = 5").select("project", "day").distinct())
    closed = lines(without_few(days, left_open, ["project", "day"]), 5, zero, zero, F.lit("(无)"))
    tied_to = written(session_refs(matches))
    refs = sieved(commits.select(*COMMIT, day_of.alias("day"), F.col("log_pos").alias("at")), COMMIT, tied_to).join(tied_to, COMMIT)
    tied = lines(refs, 4, F.col("at"), F.lit(99), F.col("refs"))

    stats = daily_stats(commits, narratives)
    begun = sessions.groupBy("project", F.to_date("started").alias("day")).agg(F.count(F.lit(1)).alias("sessions"))
    filled = capsules.filter("opened_date IS NOT NULL").groupBy("project", F.col("opened_date").alias("day")).agg(
        F.count(F.lit(1)).alias("opened"), F.count("outcome").alias("filled"))
    counted = stats.join(begun, ["project", "day"], "left").join(filled, ["project", "day"], "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    foot = F.concat(
        F.lit("commits "), text("commits"), F.lit(" | 会话 "), text("sessions"), F.lit(" | 缓存命中 "), text("cache_hits"), F.lit("/"), text("commits"),
        F.lit(" | LLM 调用 "), text("llm_calls"), F.when(F.col("opened") > 0, F.concat(F.lit(" | 胶囊回填 "), text("filled"), F.lit("/"), text("opened"))).otherwise(""))
    footer = lines(counted, 6, zero, F.lit(1), foot).unionByName(lines(days, 6, zero, zero, F.lit("---")))
    more = past.unionByName(marked).unionByName(told).unionByName(tied).unionByName(ends).unionByName(closed).unionByName(footer)
    return rows.select("project", "day", F.col("section").cast("int").alias("section"), "log_pos", "part", "line").unionByName(more.withColumn("line", redact(F.col("line"))))


def decision_notes(commits: DataFrame, narratives: DataFrame) -> DataFrame:
    """One note per commit that carries decisions, linked to the daily report of its day."""
    decided = narratives.select(*COMMIT, F.filter("decisions", lambda d: F.trim(d) != "").alias("d")).filter(F.size("d") > 0)
    rows = commits.join(decided, COMMIT)
    name = F.element_at(F.split("project", "/"), -1)
    sha7, day = F.substring("sha", 1, 7), F.date_format("date", "yyyy-MM-dd")
    text = F.concat(
        F.lit("# 决策 · `"), sha7, F.lit("`  "), redact(F.col("subject")), F.lit("\n\n来源日报:[["), day, F.lit("-"), name,
        F.lit("]]\n\n- "), F.array_join(notes.redacted_list(F.col("d")), "\n- "), F.lit("\n"))
    return rows.select("project", "sha", note_folder(name, F.col("project")).alias("folder"), F.concat(sha7, F.lit(".md")).alias("file"), text.alias("text"))


def open_loops(narratives: DataFrame, latest: int = 10) -> DataFrame:
    """Unfinished items of the newest narratives of each project, without repeats or filler, newest first."""
    recent = top_n(
        narratives.filter(~F.contains("sha", F.lit(":"))).select("project", "sha", "created_at", "open_loops"),
        ["project"], [F.col("created_at").desc(), F.col("sha")], latest)
    items = recent.select("project", "rank", F.posexplode("open_loops").alias("pos", "item"))
    kept = items.filter((F.trim("item") != "") & ~F.startswith(F.trim("item"), F.lit(K.FILLER_PREFIX)))
    return kept.groupBy("project", "item").agg(F.min(F.struct("rank", "pos")).alias("place"))


def attention(board: DataFrame, capsules: DataFrame, projects: DataFrame, top: int = 5) -> DataFrame:
    """Projects that need a look: those with unanswered predictions and the ``top`` by debt.
    Order by pending and peak, descending."""
    peaks = board.groupBy("project").agg(
        F.max("debt_exact").alias("peak"), F.max_by("file", F.struct("debt_exact", "file")).alias("file"))
    live = projects.join(peaks, "project", "left").join(CAP.pending_counts(capsules), "project", "left").select(
        "project", "file", F.coalesce("peak", F.lit(0.0)).alias("peak"), F.coalesce("pending", F.lit(0)).alias("pending"))
    live = cut_lineage(live)  # one row per project, read four times below
    worst = live.filter("peak > 0").orderBy(F.col("peak").desc(), "project").limit(top).select("project", F.lit(True).alias("_top"))
    shown = live.join(worst, "project", "left").filter((F.col("pending") > 0) | F.col("_top").isNotNull()).drop("_top")
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return shown.withColumn("omitted", count(live) - count(shown))


def brief(board: DataFrame, digests: DataFrame, capsules: DataFrame, narratives: DataFrame, commits: DataFrame) -> DataFrame:
    """One row per project: where work stopped and what waits."""
    top = top_n(board, ["project"], [F.col("debt_exact").desc(), F.col("file")], 3)
    debt = top.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file"))), lambda x: x["file"]).alias("debt_files"))
    waiting = CAP.pending_fold(capsules)
    waits = waiting.groupBy("project").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "capsule_id"))), lambda x: x["capsule_id"]).alias("pending_ids"),
        F.max("pending").alias("pending"))
    loops = open_loops(narratives)
    five = first_texts(loops, ["project"], F.col("item"), F.col("place"), 5, "open_loops")
    counts = loops.groupBy("project").agg(F.count(F.lit(1)).alias("n_loops"))
    cover = COV.last_n(commits).select("project", "got", "total")
    last = latest_daily(digests).withColumnRenamed("day", "last_day")
    out = cover
    for part in (debt, last, waits, five, counts):
        out = out.join(part, "project", "left")
    return out


# --- what would leave the machine ---------------------------------------------------------

def payload(commits: DataFrame, prior: DataFrame, matches: DataFrame, stats: DataFrame) -> DataFrame:
    """The bounded, redacted text that a model would be given for each commit.

    ``prior`` is (project, sha, prior_sha, prior_what); ``matches`` has at most two ranked rows per commit with
    ``prompts`` and ``excerpts``; ``stats`` is (project, sha, stat, diff).
    """
    def block(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(title + "\n- "), F.array_join(items, "\n- ")))

    session = F.concat_ws(
        "\n\n",
        F.concat(F.lit("### 关联会话 "), F.substring("session_id", 1, 8), F.lit("(置信度 "), "confidence", F.lit(")")),
        block("用户原话:", F.col("prompts")), block("AI 关键陈述:", F.col("excerpts")))
    sessions = matches.groupBy(*COMMIT).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", session.alias("t")))), lambda x: x["t"]), "\n\n").alias("_sessions"))
    rows = commits.join(prior, COMMIT, "left").join(sessions, COMMIT, "left").join(stats, COMMIT, "left")
    text = F.concat_ws(
        "\n\n",
        F.when(F.col("prior_what").isNotNull(), F.concat(F.lit("### 这些文件上次的改动("), F.substring("prior_sha", 1, 7), F.lit(")\n"), "prior_what")),
        F.concat(F.lit("## Commit "), F.substring("sha", 1, 10)),
        F.concat(F.lit("时间:"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" 作者:"), F.substring("author", 1, K.AUTHOR_CAP)),
        F.concat(F.lit("message:"), F.substring("subject", 1, K.SUBJECT_CAP), F.lit("\n"), F.substring("body", 1, K.BODY_CAP)),
        F.concat(F.lit("### 变更统计\n"), F.substring(F.coalesce("stat", F.lit("")), 1, K.STAT_CAP)),
        F.concat(F.lit("### diff 节选\n"), F.coalesce("diff", F.lit(""))),
        F.coalesce("_sessions", F.lit("### 无关联会话数据 —— why 字段只能基于 commit 本身,请注明属于推测")),
    )
    return rows.select(*COMMIT, redact(text).alias("payload"))


def enrichment_plan(commits: DataFrame, narratives: DataFrame) -> DataFrame:
    """What a run would do per project, before anything is sent: totals, what is missing, which kinds of text would be
    used with their caps, and how many secrets of each kind would be taken out of the missing commits' texts."""
    have = narratives.select(*COMMIT, F.lit(1).alias("_n"))
    joined = commits.select(*COMMIT, F.concat_ws("\n", "author", "subject", "body").alias("_text")).join(have, COMMIT, "left")
    # texts of commits that have a narrative are not sent
    counted = with_redaction_counts(joined.withColumn("_text", F.when(F.col("_n").isNull(), F.col("_text"))), "_text", "_c_")
    totals = counted.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_commits"), F.count("_n").alias("_have"),
        *(F.coalesce(F.sum(f"_c_{name}"), F.lit(0)).alias(f"_c_{name}") for name in SECRET_NAMES))
    kinds = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).cast("bigint").alias("cap")) for n, c in K.INPUT_CATEGORIES))
    return totals.select(
        "project", "total_commits", (F.col("total_commits") - F.col("_have")).alias("uncached_commits"),
        F.create_map(*(x for name in SECRET_NAMES for x in (F.lit(name), F.col(f"_c_{name}")))).alias("redaction_counts"), kinds.alias("categories"),
        F.lit(K.AUTHOR_CAP).cast("bigint").alias("author_cap"), F.lit(K.SUBJECT_CAP).cast("bigint").alias("subject_cap"),
        F.lit(K.BODY_CAP).cast("bigint").alias("body_cap"), F.lit(K.STAT_CAP).cast("bigint").alias("stat_cap"),
        F.lit("preserved").alias("existing_narratives"))
