"""Assistant session records of three kinds, brought to one form.

Every reader gives two tables: session summaries (source, session_id, project, title, started, ended, records,
parse_failures, is_subagent, prompts, excerpts, input, output, cache_read) and session files (source, session_id,
project, file, mode).  Text is redacted as it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions import variants as V
from whylake.functions.redact import redact
from whylake.functions.text import head_tail, parse_time, strip
from whylake.operators.ranking import top_n
from whylake.operators.sessions import as_list, is_human, is_injected
from whylake.session import cut_lineage

FILE = ["path"]


@dataclass
class Sessions:
    summaries: DataFrame
    files: DataFrame


def _lines(spark: SparkSession, path: str, pattern: str, since=None, only: list[str] | None = None) -> DataFrame:
    """JSON lines with their place: (path, at, v).  ``v`` is NULL where a line is no JSON object.  ``since`` skips files
    not modified since then before they are opened; of ``only`` (names of files) no other is opened."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    if only == []:  # nothing to open
        raw = spark.createDataFrame([], "value string, _metadata struct<file_path:string,file_block_start:bigint>")
    else:
        raw = reader.text(path if only is None else only)
    raw = raw.filter(F.trim("value") != "")
    v = V.parse(F.col("value"))
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        F.when(V.is_object(v), v).alias("v"))


def _capped(rows: DataFrame, n: int, name: str) -> DataFrame:
    """The first ``n`` texts of every file; input (path, at, text)."""
    return as_list(top_n(rows, FILE, [F.col("at")], n), FILE, name)


def _summaries(rows: DataFrame, source: str, ids: DataFrame, prompts: DataFrame, excerpts: DataFrame, usage: DataFrame | None) -> DataFrame:
    out = rows.join(ids, FILE).join(_capped(prompts, K.MAX_PROMPTS, "prompts"), FILE, "left").join(
        _capped(excerpts, K.MAX_EXCERPTS, "excerpts"), FILE, "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({"prompts": F.coalesce("prompts", empty), "excerpts": F.coalesce("excerpts", empty)})
    zero = F.lit(0).cast("bigint")
    if usage is None:
        out = out.withColumns({"input": zero, "output": zero, "cache_read": zero})
    else:
        out = out.join(usage, FILE, "left").withColumns({c: F.coalesce(c, zero) for c in ("input", "output", "cache_read")})
    if "title" not in out.columns:
        out = out.withColumn("title", F.substring(F.coalesce(F.get("prompts", F.lit(0)), F.lit("")), 1, 60))
    return out.select(
        F.lit(source).alias("source"), "session_id", "project", "title", "started", "ended", "records", "parse_failures",
        "is_subagent", "prompts", "excerpts", "input", "output", "cache_read", "path")


# --- transcripts --------------------------------------------------------------------

def read_transcripts(spark: SparkSession, path: str, since=None, only: list[str] | None = None) -> Sessions:
    """``<project>/<session>.jsonl`` and ``<project>/<session>/subagents/**/agent-*.jsonl``.

    Unknown records are ignored, lines that are no JSON are counted.  Side chains add their statements and files but no
    prompts: what looks like a user there is the orchestrator.
    """
    side = F.contains("path", F.lit("/subagents/"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", "")
    after = F.split("path", "/")
    lines = _lines(spark, path, "*.jsonl", since, only).filter(~F.endswith("path", F.lit("/journal.jsonl")))
    lines = lines.filter(~side | F.startswith(stem, F.lit("agent-")))
    project = F.when(side, F.element_at(F.split(F.substring_index("path", "/subagents/", 1), "/"), -2)).otherwise(F.element_at(after, -2))
    rec = lines.select(
        "path", "at", F.col("v").isNull().alias("bad"), side.alias("is_subagent"), F.url_decode(project).alias("project"), stem.alias("stem"),
        V.text_at(F.col("v"), "$.type").alias("type"), parse_time(V.scalar_at(F.col("v"), "$.timestamp")).alias("ts"),
        V.text_at(F.col("v"), "$.sessionId").alias("sid"), V.text_at(F.col("v"), "$.aiTitle").alias("title"), "v")
    carries = F.col("type").isin("user") | ((F.col("type") == "assistant") & F.col("is_subagent"))
    known = carries & F.col("sid").isNotNull()
    base = rec.groupBy("path").agg(
        F.first("project").alias("project"), F.first("is_subagent").alias("is_subagent"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if(~F.col("bad")).alias("records"), F.count_if("bad").alias("parse_failures"),
        F.max_by("title", F.when((F.col("type") == "ai-title") & (F.col("title") != ""), F.col("at"))).alias("_title"),
        F.coalesce(F.max_by("sid", F.when(known, F.col("at"))), F.first("stem")).alias("session_id"))
    base = base.filter("records > 0").withColumn("title", redact(F.coalesce("_title", F.lit("")))).drop("_title")

    content = F.try_variant_get("v", "$.message.content", "variant")
    blocks = V.items_at(F.col("v"), "$.message.content")
    kind = lambda b: V.text_at(b, "$.type")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: kind(b) == "text"), lambda b: F.coalesce(V.text_at(b, "$.text"), F.lit(""))), "\n")
    said = strip(F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).when(
        ~F.exists(blocks, lambda b: F.coalesce(kind(b) == "tool_result", F.lit(False))), joined))
    meta = V.flag_at(F.col("v"), "$.isMeta") | V.flag_at(F.col("v"), "$.isCompactSummary") | V.flag_at(F.col("v"), "$.isSidechain")
    users = rec.filter("type = 'user'").filter(~meta).select("path", "at", said.alias("text")).filter(is_human(F.col("text")))
    prompts = users.select("path", "at", redact(head_tail(F.col("text"), K.PROMPT_CAP)).alias("text"))

    replies = rec.filter("type = 'assistant'").filter(~V.flag_at(F.col("v"), "$.isApiErrorMessage"))
    parts = replies.select("path", "project", "at", F.posexplode(blocks).alias("pos", "b"))
    spoken = parts.filter(kind(F.col("b")) == "text").select(
        "path", F.struct("at", "pos").alias("at"), strip(F.coalesce(V.text_at(F.col("b"), "$.text"), F.lit(""))).alias("text"))
    excerpts = spoken.filter(F.length("text") > K.MIN_EXCERPT).select("path", "at", redact(head_tail(F.col("text"), K.EXCERPT_CAP)).alias("text"))
    target = F.coalesce(F.nullif(V.text_at(F.col("b"), "$.input.file_path"), F.lit("")), V.text_at(F.col("b"), "$.input.notebook_path"))
    tool = V.text_at(F.col("b"), "$.name")
    files = parts.filter(kind(F.col("b")) == "tool_use").select(
        "path", target.alias("file"), F.when(tool.isin(*K.WRITE_TOOLS), "write").when(tool == K.READ_TOOL, "read").alias("mode")).filter(
        "file IS NOT NULL AND mode IS NOT NULL").distinct()

    usage = replies.filter(V.is_object(F.try_variant_get("v", "$.message.usage", "variant"))).select(
        "path", "at", F.coalesce(V.scalar_at(F.col("v"), "$.message.id"), V.scalar_at(F.col("v"), "$.uuid")).alias("id"),
        V.number_at(F.col("v"), "$.message.usage.input_tokens").alias("input"), V.number_at(F.col("v"), "$.message.usage.output_tokens").alias("output"),
        V.number_at(F.col("v"), "$.message.usage.cache_read_input_tokens").alias("cache_read"))
    last = usage.groupBy("path", "id").agg(F.max_by(F.struct("input", "output", "cache_read"), "at").alias("u"))
    tokens = last.groupBy("path").agg(F.sum("u.input").alias("input"), F.sum("u.output").alias("output"), F.sum("u.cache_read").alias("cache_read"))

    ids = base.select("path", "session_id", "project", "is_subagent", "title")
    summaries = _summaries(base.drop("session_id", "project", "is_subagent", "title"), "claude", ids, prompts, excerpts, tokens)
    return Sessions(summaries, files.join(ids.select("path", "session_id", "project"), "path").select(
        F.lit("claude").alias("source"), "session_id", "project", "file", "mode").distinct())


# --- rollouts ---------------------------------------------------------------------------

def read_rollouts(spark: SparkSession, path: str, since=None, only: list[str] | None = None) -> Sessions:
    """``rollout-*.jsonl``: the first record has to be the session meta, whose working directory is the project.

    Only paths are taken from patch calls; their text may hold secrets and is never kept.
    """
    lines = _lines(spark, path, "rollout-*.jsonl", since, only).withColumn("type", V.text_at(F.col("v"), "$.type"))
    first = lines.groupBy("path").agg(F.min_by(F.struct("type", V.text_at(F.col("v"), "$.payload.cwd").alias("cwd")), "at").alias("f"))
    owned = first.filter("f.type = 'session_meta' AND f.cwd IS NOT NULL").select("path", F.col("f.cwd").alias("project"))
    rec = lines.join(owned, "path")
    payload = F.try_variant_get("v", "$.payload", "variant")
    meta = (F.col("type") == "session_meta") & V.is_object(payload)
    sid = F.coalesce(V.text_at(F.col("v"), "$.payload.session_id"), V.text_at(F.col("v"), "$.payload.id"))
    item = rec.filter((F.col("type") == "response_item") & V.is_object(payload)).withColumn("kind", V.text_at(F.col("v"), "$.payload.type"))
    texts = F.filter(F.transform(V.items_at(F.col("v"), "$.payload.content"), lambda c: V.text_at(c, "$.text")), lambda x: x.isNotNull())
    said = item.filter("kind = 'message'").select(
        "path", "at", V.text_at(F.col("v"), "$.payload.role").alias("role"), strip(F.array_join(texts, "")).alias("text")).filter("text <> ''")
    asked = said.filter("role = 'user'").filter(~is_injected(F.col("text")))
    told = said.filter("role = 'assistant'")
    counts = asked.unionByName(told).groupBy("path").agg(F.count(F.lit(1)).alias("records"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", "")
    base = rec.groupBy("path").agg(
        F.first("project").alias("project"),
        F.min(F.when(~meta, parse_time(V.scalar_at(F.col("v"), "$.timestamp")))).alias("started"),
        F.max(F.when(~meta, parse_time(V.scalar_at(F.col("v"), "$.timestamp")))).alias("ended"),
        F.count_if(F.col("v").isNull()).alias("parse_failures"),
        F.max_by(sid, F.when(meta & sid.isNotNull(), F.col("at"))).alias("_sid")).join(counts, "path")
    ids = base.select("path", F.coalesce("_sid", stem).alias("session_id"), "project", F.lit(False).alias("is_subagent"))
    cut = lambda rows, n: rows.select("path", "at", redact(head_tail(F.col("text"), n)).alias("text"))
    summaries = _summaries(base.drop("project", "_sid"), "codex", ids, cut(asked, K.PROMPT_CAP), cut(told, K.EXCERPT_CAP), None)
    blob = F.coalesce(V.text_at(F.col("v"), "$.payload.input"), V.text_at(F.col("v"), "$.payload.arguments"))
    calls = item.filter("kind IN ('function_call', 'custom_tool_call')").select(
        "path", "project", F.explode(F.regexp_extract_all(blob, F.lit(K.PATCH_FILE_PATTERN), F.lit(1))).alias("file"))
    files = calls.select("path", absolute(strip(F.col("file")), F.col("project")).alias("file")).join(ids, "path").select(
        F.lit("codex").alias("source"), "session_id", "project", "file", F.lit("write").alias("mode")).distinct()
    return Sessions(summaries, files)


# --- key-value dumps ------------------------------------------------------------------------

def absolute(path: Column, root: Column) -> Column:
    """file:// links decoded; relative paths put below the root."""
    local = F.when(F.startswith(path, F.lit("file://")), F.url_decode(F.regexp_replace(F.regexp_replace(path, "^file://[^/]*", ""), r"\+", "%2B"))).otherwise(path)
    return F.when(F.startswith(local, F.lit("/")), local).otherwise(F.concat(root, F.lit("/"), local))


def paths_of(items: Column) -> Column:
    """Paths in a list of strings or objects with uri, relativeWorkspacePath or fsPath (a uri may be an object itself)."""
    def one(x: Column) -> Column:
        first = F.coalesce(
            F.nullif(V.text_at(x, "$.uri"), F.lit("")), F.nullif(V.text_at(x, "$.uri.path"), F.lit("")), V.text_at(x, "$.uri.fsPath"),
            F.nullif(V.text_at(x, "$.relativeWorkspacePath"), F.lit("")), V.text_at(x, "$.fsPath"))
        return F.coalesce(V.text_at(x, "$"), first)

    return F.filter(F.transform(items, one), lambda p: p.isNotNull())


CONTEXT_LISTS = ("relevantFiles", "recentlyViewedFiles", "attachedCodeChunks", "attachedFileCodeChunksMetadataOnly")


def read_key_values(rows: DataFrame, projects: DataFrame) -> Sessions:
    """A dump (key, value) of ``composerData:<id>`` and ``bubbleId:<id>:<n>`` with ``projects`` (session_id, project).

    Files a message refers to are context, never written; written are the added and removed files of the composer or,
    only when it names none, the files of suggested diffs.
    """
    keyed = rows.select(F.split("key", ":").alias("k"), V.parse(F.col("value")).alias("v"), "key").filter(V.is_object(F.col("v")))
    heads = keyed.filter(F.col("k")[0] == "composerData").select(F.col("k")[1].alias("session_id"), F.col("v").alias("head"))
    bubbles = keyed.filter(F.col("k")[0] == "bubbleId").select(F.col("k")[1].alias("session_id"), "key", "v").join(projects, "session_id")
    created = F.try_variant_get("v", "$.createdAt", "variant")
    numeric = F.try_variant_get(created, "$", "double")
    ms = F.coalesce(numeric, V.scalar_at(F.col("v"), "$.createdAt").try_cast("double"))
    said = bubbles.withColumns({
        "at": F.struct(F.coalesce(ms, F.lit(0.0)).alias("ms"), "key"), "ts": F.timestamp_millis(ms.cast("bigint")),
        "text": strip(F.coalesce(V.text_at(F.col("v"), "$.text"), F.lit(""))), "type": F.try_variant_get("v", "$.type", "int"),
        "path": F.col("session_id")})
    base = said.groupBy("path").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if(F.col("text") != "").alias("records"),
        F.lit(0).cast("bigint").alias("parse_failures")).filter("records > 0")
    cut = lambda kind, n: said.filter((F.col("type") == kind) & (F.col("text") != "")).select("path", "at", redact(head_tail(F.col("text"), n)).alias("text"))
    ids = projects.select(F.col("session_id").alias("path"), "session_id", "project", F.lit(False).alias("is_subagent"))
    summaries = _summaries(base, "cursor", ids, cut(1, K.PROMPT_CAP), cut(2, K.EXCERPT_CAP), None)
    drafts = heads.select("session_id", F.substring(redact(F.coalesce(V.text_at(F.col("head"), "$.text"), F.lit(""))), 1, 60).alias("_draft"))
    summaries = summaries.join(drafts, "session_id", "left").withColumn(
        "title", F.when(F.size("prompts") > 0, F.col("title")).otherwise(F.coalesce("_draft", F.lit("")))).drop("_draft").select(*summaries.columns)

    read = bubbles.select("session_id", "project", F.explode(F.concat(*[paths_of(V.items_at(F.col("v"), f"$.{name}")) for name in CONTEXT_LISTS])).alias("file"), F.lit("read").alias("mode"))
    edited = heads.join(projects, "session_id").select("session_id", "project", F.array_union(
        paths_of(V.items_at(F.col("head"), "$.addedFiles")), paths_of(V.items_at(F.col("head"), "$.removedFiles"))).alias("paths"))
    direct = edited.select("session_id", "project", F.explode("paths").alias("file"), F.lit("write").alias("mode"))
    suggested = bubbles.join(edited.filter(F.size("paths") > 0).select("session_id"), "session_id", "left_anti").select(
        "session_id", "project", F.explode(paths_of(V.items_at(F.col("v"), "$.assistantSuggestedDiffs"))).alias("file"), F.lit("write").alias("mode"))
    files = read.unionByName(direct).unionByName(suggested).select(
        F.lit("cursor").alias("source"), "session_id", "project", absolute(F.col("file"), F.col("project")).alias("file"), "mode").distinct()
    return Sessions(summaries, files)


def union(choice: str, **sources: Sessions) -> Sessions:
    """The chosen sources together; a source that could not be read is left out by not passing it."""
    wanted = [s for name, s in sources.items() if name in K.SOURCE_CHOICES.get(choice, (choice,))]
    summaries, files = wanted[0].summaries, wanted[0].files
    for more in wanted[1:]:
        summaries, files = summaries.unionByName(more.summaries), files.unionByName(more.files)
    return Sessions(summaries, files)


# --- incremental reading -----------------------------------------------------------------------

def file_states(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, modified, size) of the files below a folder, without reading their content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def changed_files(now: DataFrame, known: DataFrame, since=None) -> DataFrame:
    """Files to read again: new or changed since the stored state (path, modified, size), none older than ``since``."""
    fresh = now if since is None else now.filter(F.col("modified") >= F.lit(since))
    return fresh.join(known, ["path", "modified", "size"], "left_anti")


def merge_summaries(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored summaries stay for unchanged files and give way to re-read ones."""
    return stored.join(fresh.select("path").distinct(), "path", "left_anti").select(*stored.columns).unionByName(fresh)


def refresh(spark: SparkSession, path: str, reader, stored: Sessions | None, known: DataFrame | None, since=None) -> tuple[Sessions, DataFrame]:
    """Sessions after a scan that opens only what is new or changed, and the states of the files to store for the next one.

    ``stored`` and ``known`` are what the scan before gave, ``reader`` is one of the readers above.  Files are compared by
    path, time and size.  Names of changed files are listed on the driver, as Spark's own listing of the folder is.  Sessions of
    files that are gone stay.  The files of sessions hold no path, so those of sessions that were read again give way by session.
    """
    now = cut_lineage(file_states(spark, path))
    if stored is None or known is None:
        return reader(spark, path, since), now
    only = [r.path for r in changed_files(now, known, since).select("path").collect()]
    fresh = reader(spark, path, only=only)
    again = fresh.summaries.select("source", "session_id").distinct()
    files = stored.files.join(again, ["source", "session_id"], "left_anti").unionByName(fresh.files)
    return Sessions(merge_summaries(stored.summaries, fresh.summaries), files), now
