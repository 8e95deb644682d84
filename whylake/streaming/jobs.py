"""Structured Streaming forms of the incremental jobs.  Each has a batch twin; after all input both agree."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from whylake import constants as K
from whylake.operators.align import time_pairs

SESSION = ["project", "source", "session_id"]


# --- session roll-up -----------------------------------------------------------------------

def partial_sessions(records: DataFrame) -> DataFrame:
    """Mergeable roll-up of a batch of records (project, source, session_id, line_no, ts, title, file, mode)."""
    titled = F.when(F.col("title").isNotNull(), F.col("line_no"))
    return records.groupBy(*SESSION, "file").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("records"),
        F.max_by("title", titled).alias("title"), F.max(titled).alias("title_at"),
        F.bool_or(F.col("mode") == "write").alias("written"), F.bool_or(F.col("mode") == "read").alias("read"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """The partial roll-ups of several batches as one."""
    return partials.groupBy(*SESSION, "file").agg(
        F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("records").alias("records"),
        F.max_by("title", "title_at").alias("title"), F.max("title_at").alias("title_at"), F.bool_or("written").alias("written"),
        F.bool_or("read").alias("read"))


def merge_sessions(partials: DataFrame) -> DataFrame:
    """Session rows from the partial roll-ups of all batches; equals ``operators.sessions.roll_up``."""
    named = F.col("file").isNotNull()
    return merge_partials(partials).groupBy(*SESSION).agg(
        F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("records").alias("records"),
        F.max_by("title", "title_at").alias("title"), F.count_if(F.col("written") & named).alias("files_written"),
        F.count_if(F.col("read") & named).alias("files_read"))


def ingest_sessions(records: DataFrame, path: str, checkpoint: str):
    """Write the partial roll-up of every batch to its own partition.

    A batch that is replayed after a failure overwrites its partition, so no record counts twice; no state is kept in
    the stream, however long sessions stay open.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        partial_sessions(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


# Compacted batches are read from a generation in their place.  What is read is told by the newest version: a row with the name
# of the generation and the last batch that it holds, in a folder of its own that counts once it is whole.  A batch that is replayed
# after it was compacted is in the generation already and is not read again.

VERSION = "generation string, last_batch bigint"


def _names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Sorted names of the folders that begin with ``prefix``, in whatever store they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return sorted(n for n in found if n.startswith(prefix))


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _versions(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _names(spark, path, "_version-") if _exists(spark, f"{path}/{n}/_SUCCESS")]


def _read_set(spark: SparkSession, path: str) -> tuple[str | None, int, list[str]]:
    """The generation in force, its last batch, and the folders of the batches behind it."""
    versions = _versions(spark, path)
    generation, last = spark.read.schema(VERSION).json(f"{path}/{versions[-1]}").first() if versions else (None, -1)
    return generation, last, [n for n in _names(spark, path, "batch=") if int(n.removeprefix("batch=")) > last]


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """All partial roll-ups, each batch once."""
    generation, _, batches = _read_set(spark, path)
    parts = [f"{path}/{n}" for n in ([generation] if generation else []) + batches]
    return spark.read.parquet(*parts)


def compact_sessions(spark: SparkSession, path: str) -> None:
    """Merge the generation and all whole batches behind it into the next generation, and switch to it."""
    generation, last, batches = _read_set(spark, path)
    if not batches:
        return
    number = len(_versions(spark, path))
    # named after its version and never reused, so a run that broke off leaves nothing that is read
    following = f"_generation-{number:08d}-{uuid.uuid4().hex}"
    merge_partials(read_partials(spark, path)).write.parquet(f"{path}/{following}")
    newest = max(int(n.removeprefix("batch=")) for n in batches)
    spark.createDataFrame([(following, newest)], VERSION).coalesce(1).write.json(f"{path}/_version-{number:08d}")


def vacuum_sessions(spark: SparkSession, path: str) -> None:
    """Delete what neither the version in force nor the one before it reads."""
    versions = _versions(spark, path)
    if len(versions) < 2:
        return
    (kept, last), (newest, _) = (spark.read.schema(VERSION).json(f"{path}/{v}").first() for v in versions[-2:])
    gone = [n for n in _names(spark, path, "_generation-") if n not in (kept, newest) and n < newest]
    gone += [n for n in _names(spark, path, "batch=") if int(n.removeprefix("batch=")) <= last]
    for name in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# --- usage -------------------------------------------------------------------------------------

def usage_by_day(usage: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tumbling days per command."""
    return usage.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "command").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("llm_calls").alias("llm_calls"), F.sum("tokens_in").alias("tokens_in"),
        F.count_if(F.col("llm_calls") == 0).alias("zero_call_runs")).select(
        F.to_date("window.start").alias("day"), "command", "runs", "llm_calls", "tokens_in", "zero_call_runs")


def unique_messages(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Usage lines without the repeats of one streamed message."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*SESSION, "message_id"])


# --- drift ----------------------------------------------------------------------------------------

def drift_events(writes: DataFrame, commits: DataFrame, deadline: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Writes (project, source, session_id, file, acted_at) joined with the commits (project, file, date) that follow
    within ``deadline``; a write without one comes out with a NULL commit date once the watermark has passed."""
    w = writes.withWatermark("acted_at", delay).alias("w")
    c = commits.select("project", "file", "date").withWatermark("date", delay).alias("c")
    near = F.expr(
        f"w.project = c.project AND w.file = c.file AND c.date >= w.acted_at - interval {K.TIME_SLACK_MINUTES} minutes "
        f"AND c.date <= w.acted_at + interval {deadline}")
    return w.join(c, near, "leftOuter").select("w.project", "w.source", "w.session_id", "w.file", "w.acted_at", F.col("c.date").alias("landed_at"))


FLAGS = StructType([
    StructField("source", StringType()), StructField("session_id", StringType()), StructField("acted_at", TimestampType()), StructField("landed", BooleanType())])


class LandedFlags(StatefulProcessor):
    """Pending writes of one file of a project, and the dates of its recent commits.

    A write is settled by the first commit that is late enough, whichever of them arrives first; its timer, at the
    deadline, says that it has not landed if none came.  A settled write is remembered until then, so repeats say nothing
    new.  Commits are kept as long as a write may come that they settle.
    """

    def __init__(self, slack_ms: int, deadline_ms: int):
        self.slack, self.deadline = slack_ms, deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.writes = handle.getMapState("writes", StructType([
            StructField("source", StringType()), StructField("session_id", StringType()), StructField("at", LongType())]), StructType([StructField("settled", BooleanType())]))
        self.commits = handle.getListState("commits", StructType([StructField("at", LongType())]))

    def settles(self, commit: int, write: int) -> bool:
        return write - self.slack <= commit <= write + self.deadline

    def said(self, key, rows: list) -> pd.DataFrame:
        columns = ["project", "file", "source", "session_id", "acted_at", "landed"]
        return pd.DataFrame([(*key, s, i, pd.Timestamp(at, unit="ms"), landed) for s, i, at, landed in rows], columns=columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        commits, out = [c[0] for c in self.commits.get()], []
        known = len(commits)
        for frame in rows:
            for row in frame.itertuples(index=False):
                at = row.ts.value // 1_000_000
                if row.kind == "commit":
                    if at not in commits:
                        commits.append(at)
                        out += self.settled_by(at)
                elif not self.writes.containsKey(write := (row.source, row.session_id, at)):
                    landed = any(self.settles(c, at) for c in commits)
                    self.writes.updateValue(write, (landed,))
                    self.handle.registerTimer(at + self.deadline)
                    if landed:
                        out.append((*write, True))
        if len(commits) > known:
            self.commits.put([(c,) for c in commits])
            self.handle.registerTimer(max(commits) + self.slack + self.deadline)
        yield self.said(key, out)

    def settled_by(self, commit: int) -> list:
        due = [w for w, (settled,) in self.writes.iterator() if not settled and self.settles(commit, w[2])]
        for write in due:
            self.writes.updateValue(write, (True,))
        return [(*write, True) for write in due]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for write, (settled,) in list(self.writes.iterator()):
            if write[2] + self.deadline <= now:
                self.writes.removeKey(write)
                if not settled:
                    out.append((*write, False))
        # writes that may still come are not before the watermark
        recent = [(c[0],) for c in self.commits.get() if c[0] + self.slack >= timerValues.getCurrentWatermarkInMs()]
        if recent:
            self.commits.put(recent)
        else:
            self.commits.clear()
        yield self.said(key, out)

    def close(self) -> None:
        pass


def drift_flags(writes: DataFrame, commits: DataFrame, deadline_days: int = 7, delay: str = "1 hour", slack_minutes: int = K.TIME_SLACK_MINUTES) -> DataFrame:
    """One row for each write (project, source, session_id, file, acted_at) with ``landed``: whether a commit (project, file,
    date) on the same path follows within the deadline.  The rows do not depend on the order of arrival, as long as nothing is later
    than ``delay``.  State is one small row per open write and recent commit of a file."""
    none = F.lit(None).cast("string")
    w = writes.select("project", "file", F.lit("write").alias("kind"), "source", "session_id", F.col("acted_at").alias("ts"))
    c = commits.select("project", "file", F.lit("commit").alias("kind"), none.alias("source"), none.alias("session_id"), F.col("date").alias("ts"))
    processor = LandedFlags(slack_minutes * 60_000, deadline_days * 86_400_000)
    schema = StructType([StructField("project", StringType()), StructField("file", StringType()), *FLAGS.fields])
    return w.unionByName(c).withWatermark("ts", delay).groupBy("project", "file").transformWithStateInPandas(
        processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


# --- alignment ---------------------------------------------------------------------------------------

def align_stream(commits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Time matches of arriving commits with the known sessions (stream-static)."""
    return time_pairs(commits, sessions)


def align_matches(commits: DataFrame, sessions: DataFrame, delay: str = "1 hour", longest: str = "1 day", horizon: str = "7 days", slack_minutes: int = K.TIME_SLACK_MINUTES) -> DataFrame:
    """Matches of arriving commits (project, sha, date, files) with arriving sessions (project, source, session_id, started,
    ended, files written), with their shared files and confidence, as ``align.align`` has them.

    Two interval joins, by time and by file, meet in one aggregation over the hour of the commit, which is emitted once
    nothing can change it: a match that is first known by one of the two and later by the other comes out as ``high``.  Sessions
    are at most ``longest``, and files are matched within ``horizon``; state is dropped behind both.
    """
    slack = F.expr(f"interval {slack_minutes} minutes")
    c, s = commits.withWatermark("date", delay).alias("c"), sessions.withWatermark("started", delay).alias("s")
    # a commit lies in one day, a session in the days that it touches: hours would be finer, but state grows with them
    day = lambda at: F.datediff(at, F.lit("1970-01-01"))
    c_days = c.withColumn("_day", day(F.col("date")))
    s_days = s.withColumn("_day", F.explode(F.sequence(day(F.col("started") - slack), day(F.col("ended") + slack))))
    own = ["c.project", "c.sha", "c.date", "s.source", "s.session_id"]
    by_time = c_days.alias("c").join(s_days.alias("s"), F.expr(
        f"c.project = s.project AND c._day = s._day AND c.date >= s.started - interval {slack_minutes} minutes AND c.date <= s.ended + interval {slack_minutes} minutes "
        f"AND c.date <= s.started + interval {longest} + interval {slack_minutes} minutes")).select(*own, F.lit(None).cast("string").alias("file"))
    c_files, s_files = c.withColumn("file", F.explode("files")), s.withColumn("file", F.explode("files"))
    by_file = c_files.alias("c").join(s_files.alias("s"), F.expr(
        f"c.project = s.project AND c.file = s.file AND c.date >= s.started - interval {horizon} AND c.date <= s.started + interval {horizon}")).select(*own, "c.file")
    met = by_time.union(by_file).groupBy(F.window("date", "1 hour"), "project", "sha", "source", "session_id").agg(
        F.max(F.col("file").isNull()).alias("in_window"), F.array_sort(F.collect_set("file")).alias("overlap"))
    return met.select(
        "project", "sha", "source", "session_id", "overlap", F.size("overlap").cast("bigint").alias("n_overlap"),
        F.when(F.col("in_window") & (F.size("overlap") > 0), "high").otherwise("low").alias("confidence"))


# --- capsules ------------------------------------------------------------------------------------------

CAPSULE_EVENTS = StructType([
    StructField("capsule_id", StringType()), StructField("event", StringType()), StructField("at", StringType())])


#: How long an answer waits for its seal, and how long an answered capsule is remembered, in milliseconds.
KEPT_MS = 90 * 86_400_000


class CapsuleTimers(StatefulProcessor):
    """Sealed capsules open when event time reaches their opening date, and close when they are answered.

    Seal and answer may arrive in either order: an answer that comes first waits for its seal.  State is cleared some
    time after the answer, or if the seal never comes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("capsule", StructType([
            StructField("status", StringType()), StructField("open_date", StringType()), StructField("outcome", StringType()), StructField("until", LongType())]))

    def keep(self, status: str, day: str | None, outcome: str | None, ts: pd.Timestamp) -> None:
        """Store the state and have it cleared later."""
        begin = max([ts, *([pd.Timestamp(day)] if day else [])])
        until = int(begin.timestamp() * 1000) + KEPT_MS
        self.state.update((status, day, outcome, until))
        self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        # the events of one capsule: a seal and an answer, perhaps repeated
        for row in sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: r.ts):
            status, day, outcome, _ = self.state.get() if self.state.exists() else (None, None, None, None)
            if row.kind == "sealed" and status is None:
                self.state.update(("sealed", str(row.open_date), None, 0))
                self.handle.registerTimer(int(pd.Timestamp(row.open_date).timestamp() * 1000))
            elif row.kind == "sealed" and status == "waiting":
                out.append((key[0], "answered", outcome))
                self.keep("answered", str(row.open_date), outcome, row.ts)
            elif row.kind == "answered" and status is None:
                self.keep("waiting", None, str(row.outcome), row.ts)
            elif row.kind == "answered" and status in ("sealed", "opened"):
                out.append((key[0], "answered", str(row.outcome)))
                self.keep("answered", day, str(row.outcome), row.ts)
        yield pd.DataFrame(out, columns=["capsule_id", "event", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            status, day, outcome, until = self.state.get()
            if status == "sealed":
                self.state.update(("opened", day, None, 0))
                out.append((key[0], "opened", day))
            elif status in ("answered", "waiting") and expiredTimerInfo.getExpiryTimeInMs() >= until:
                self.state.clear()
        yield pd.DataFrame(out, columns=["capsule_id", "event", "at"])

    def close(self) -> None:
        pass


def capsule_timers(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events (capsule_id, kind sealed|answered, ts, open_date, outcome) to opened and answered events.

    State is one small row per capsule.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    return events.withWatermark("ts", delay).groupBy("capsule_id").transformWithStateInPandas(
        CapsuleTimers(), outputStructType=CAPSULE_EVENTS, outputMode="Append", timeMode="EventTime")
