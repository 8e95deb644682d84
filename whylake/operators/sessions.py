"""Roll-up of assistant session records.

Long tables stay long: a session is one row of scalars, its files are rows of their own, and only capped lists
(prompts, excerpts) become arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions.redact import redact
from whylake.functions.text import head_tail, strip
from whylake.operators.ranking import top_n

SESSION = ["project", "source", "session_id"]


def is_human(text: Column) -> Column:
    """A genuine prompt: not blank and not one of the synthetic openings."""
    keep = text != ""
    for prefix in K.SYNTHETIC_PREFIXES:
        keep = keep & ~F.startswith(text, F.lit(prefix))
    return keep


def is_injected(text: Column) -> Column:
    """Context blocks a tool adds to every turn."""
    opening = F.ltrim(text)
    return F.startswith(opening, F.lit(K.INJECTED_PREFIXES[0])) | F.startswith(opening, F.lit(K.INJECTED_PREFIXES[1]))


def prompts(turns: DataFrame) -> DataFrame:
    """Human prompts, shortened at both ends and redacted."""
    text = strip(F.col("text"))
    rows = turns.filter("role = 'user'").withColumn("text", text).filter(is_human(F.col("text")))
    return rows.withColumn("text", redact(head_tail(F.col("text"), K.PROMPT_CAP)))


def excerpts(turns: DataFrame) -> DataFrame:
    """Assistant statements long enough to carry reasoning."""
    rows = turns.filter("role = 'assistant'").withColumn("text", strip(F.col("text"))).filter(F.length("text") > K.MIN_EXCERPT)
    return rows.withColumn("text", redact(head_tail(F.col("text"), K.EXCERPT_CAP)))


def first_of_session(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return top_n(rows, keys, [F.col("line_no")], n)


def as_list(ranked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Ranked rows of at most a few dozen per session as one array in order."""
    return ranked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias(name))


def roll_up(records: DataFrame) -> DataFrame:
    """One row per session: span, record count, last title, numbers of files written and read.

    ``records`` is (project, source, session_id, line_no, ts, title, file, mode).  Reducing to session and file first
    turns the two distinct counts into plain ones.
    """
    per_file = records.groupBy(*SESSION, "file").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("records"),
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("line_no"))).alias("title"),
        F.max(F.when(F.col("title").isNotNull(), F.col("line_no"))).alias("at"),
        F.bool_or(F.col("mode") == "write").alias("written"), F.bool_or(F.col("mode") == "read").alias("read"))
    return per_file.groupBy(*SESSION).agg(
        F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("records").alias("records"),
        F.max_by("title", "at").alias("title"),
        F.count_if(F.col("written") & F.col("file").isNotNull()).alias("files_written"),
        F.count_if(F.col("read") & F.col("file").isNotNull()).alias("files_read"))


def token_usage(messages: DataFrame) -> DataFrame:
    """Sum of tokens per session.  A message is logged once per streamed line: the last line of an id counts.

    ``messages`` is (project, source, session_id, message_id, line_no, input, output, cache_read).
    """
    last = messages.groupBy(*SESSION, "message_id").agg(
        F.max_by(F.struct("input", "output", "cache_read"), "line_no").alias("u"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return last.groupBy(*SESSION).agg(
        F.sum(zero("u.input")).alias("input"), F.sum(zero("u.output")).alias("output"),
        F.sum(zero("u.cache_read")).alias("cache_read"))


def select_sources(choice: str, **by_source: DataFrame) -> DataFrame:
    """Bag union of the chosen session sources; a source that is missing is simply not part of it."""
    wanted = K.SOURCE_CHOICES.get(choice, (choice,))
    chosen = [df.withColumn("source", F.lit(name)) for name, df in by_source.items() if name in wanted]
    if not chosen:
        raise ValueError(f"no session source for {choice!r}")
    result = chosen[0]
    for df in chosen[1:]:
        result = result.unionByName(df)
    return result


def inventory(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project").agg(
        F.count_if(~F.col("is_subagent")).alias("main"), F.count_if("is_subagent").alias("side_chains"))


def prompt_timeline(sessions: DataFrame, session_files: DataFrame, commits_of: DataFrame, texts: DataFrame, shown_files: int = 8,
                    shown_commits: int = 5, shown_excerpts: int = 3, excerpt_chars: int = 200) -> DataFrame:
    """Sessions as a reading list: day, span, prompts, the first excerpts in short, the first files in order, the first
    softly aligned commits.  ``commits_of`` comes from ``align.session_commits``; ``texts`` is (project, source,
    session_id, prompts, excerpts).  Order by started (NULLs last)."""
    none = F.array().cast("array<string>")
    said = texts.select(
        *SESSION, F.transform(F.coalesce("prompts", none), redact).alias("prompts"),
        F.transform(F.slice(F.coalesce("excerpts", none), 1, shown_excerpts), lambda x: F.substring(redact(x), 1, excerpt_chars)).alias("excerpts"))
    written = session_files.filter("mode = 'write'").select(*SESSION, "file").distinct()
    counts = written.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n_files"))
    files = as_list(top_n(written, SESSION, [F.col("file")], shown_files).withColumnRenamed("file", "text"), SESSION, "files")
    refs = commits_of.withColumn("text", F.concat(F.lit("["), "sha7", F.lit("] "), redact(F.col("subject"))))
    refs = as_list(top_n(refs, SESSION, [F.col("log_pos"), F.col("sha7")], shown_commits), SESSION, "commits")
    hhmm = lambda c: F.coalesce(F.date_format(c, "HH:mm"), F.lit("--:--"))
    whole = sessions.join(counts, SESSION, "left").join(files, SESSION, "left").join(refs, SESSION, "left").join(said, SESSION, "left")
    return whole.select(
        *SESSION, "started", F.coalesce(F.date_format("started", "yyyy-MM-dd"), F.lit("未知时间")).alias("day"),
        F.concat(hhmm("started"), F.lit("–"), hhmm("ended")).alias("span"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"), "files", "commits", F.coalesce("prompts", none).alias("prompts"),
        F.coalesce("excerpts", none).alias("excerpts"))
