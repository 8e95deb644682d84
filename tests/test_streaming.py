"""Streams give what the batch gives once all input has arrived."""

import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from whylake import constants as K
from whylake.operators import align, drift
from whylake.operators import sessions as S
from whylake.streaming import jobs

T0 = datetime(2024, 5, 1, 12)


def stream_of(spark, path, rows, schema, chunks=3):
    """JSON files that arrive one per trigger."""
    path.mkdir(parents=True)
    step = -(-len(rows) // chunks)
    names = [c.split()[0] for c in schema.split(", ")]
    for i in range(chunks):
        part = rows[i * step:(i + 1) * step]
        file = path / f"{i:03d}.json"
        file.write_text("\n".join(json.dumps({n: v.isoformat() if isinstance(v, datetime) else v for n, v in zip(names, r, strict=True)}) for r in part))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_session_ingest_equals_batch_and_survives_replay(spark, tmp_path):
    schema = "project string, source string, session_id string, line_no int, ts timestamp, title string, file string, mode string"
    rows = [("p", "claude", "s%d" % (i % 3), i, T0 + timedelta(minutes=i * 7 % 50), "t%d" % i if i % 4 == 0 else None, "f%d" % (i % 5) if i % 6 else None,
             "write" if i % 2 else "read") for i in range(40)]
    stream = stream_of(spark, tmp_path / "in", rows, schema)
    out = str(tmp_path / "out")
    q = jobs.ingest_sessions(stream, out, str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    # the same batches again under a new checkpoint: their partitions are overwritten, nothing counts twice
    q = jobs.ingest_sessions(stream, out, str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    got = jobs.merge_sessions(spark.read.parquet(out)).orderBy("session_id").collect()
    want = S.roll_up(spark.createDataFrame(rows, schema)).orderBy("session_id").collect()
    assert got == want


def test_compaction_of_batches(spark, tmp_path):
    """Few folders, a replayed batch counted once, and readers that see one version throughout."""
    schema = "project string, source string, session_id string, line_no int, ts timestamp, title string, file string, mode string"
    rows = [("p", "claude", "s%d" % (i % 3), i, T0 + timedelta(minutes=i * 7 % 50), "t%d" % i if i % 4 == 0 else None, "f%d" % (i % 5) if i % 6 else None,
             "write" if i % 2 else "read") for i in range(40)]
    out = str(tmp_path / "out")

    def put(batch):
        part = spark.createDataFrame(rows[4 * batch : 4 * batch + 4], schema)
        jobs.partial_sessions(part).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    def state():
        return jobs.merge_sessions(jobs.read_partials(spark, out)).orderBy("session_id").collect()

    def want(n):
        return S.roll_up(spark.createDataFrame(rows[: 4 * n], schema)).orderBy("session_id").collect()

    for batch in range(4):
        put(batch)
    before = jobs.merge_sessions(jobs.read_partials(spark, out)).orderBy("session_id")
    jobs.compact_sessions(spark, out)
    assert before.collect() == want(4) and state() == want(4)  # the reader of the old version goes on
    put(2)  # replayed after it was compacted
    assert state() == want(4)
    for batch in range(4, 10):
        put(batch)
        jobs.compact_sessions(spark, out)
        jobs.vacuum_sessions(spark, out)
        assert state() == want(batch + 1)
    os.makedirs(f"{out}/_version-99999999")  # a switch that broke off
    assert state() == want(10)
    names = os.listdir(out)
    assert sum(n.startswith("batch=") for n in names) <= 2 and sum(n.startswith("_generation") for n in names) <= 2
    jobs.compact_sessions(spark, out)
    assert state() == want(10)


def test_usage_by_day(spark, tmp_path):
    schema = "command string, ts timestamp, llm_calls bigint, tokens_in bigint"
    rows = [("digest" if i % 2 else "graph", T0 + timedelta(hours=6 * i), i % 3, i) for i in range(12)]
    rows += [("late", T0 - timedelta(days=5), 0, 1), ("mark", T0 + timedelta(days=20), 0, 0), ("mark", T0 + timedelta(days=20), 0, 0)]
    table = run(jobs.usage_by_day(stream_of(spark, tmp_path / "in", rows, schema, 5)), "usage_days")
    got = {(r.command, r.day, r.runs, r.tokens_in) for r in table.collect() if r.command in ("digest", "graph")}
    batch = spark.createDataFrame(rows, schema).filter("command IN ('digest', 'graph')").groupBy("command", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("tokens_in").alias("t"))
    assert got == {tuple(r) for r in batch.collect()}


def test_unique_messages(spark, tmp_path):
    schema = "project string, source string, session_id string, message_id string, ts timestamp"
    rows = [("p", "claude", "s", "m%d" % (i // 3), T0 + timedelta(seconds=i)) for i in range(12)]
    assert run(jobs.unique_messages(stream_of(spark, tmp_path / "in", rows, schema)), "unique_messages").count() == 4


def test_drift_stream(spark, tmp_path):
    wschema = "project string, source string, session_id string, file string, acted_at timestamp"
    cschema = "project string, file string, date timestamp"
    end = T0 + timedelta(days=60)
    writes = [("p", "claude", "s", "a", T0), ("p", "claude", "s", "b", T0), ("p", "claude", "end", "z", end), ("p", "claude", "end", "y", end)]
    commits = [("p", "a", T0 + timedelta(days=1)), ("p", "b", T0 - timedelta(hours=5)), ("p", "w", end), ("p", "v", end)]
    joined = jobs.drift_events(stream_of(spark, tmp_path / "w", writes, wschema, 4), stream_of(spark, tmp_path / "c", commits, cschema, 4))
    rows = {(r.file, r.landed_at is not None) for r in run(joined, "drift_events").collect()}
    assert {r for r in rows if r[0] in "ab"} == {("a", True), ("b", False)}


def test_drift_flags_equal_batch_in_any_order(spark, tmp_path):
    """One row for each write, the same whatever arrives first."""
    wschema = "project string, source string, session_id string, file string, acted_at timestamp"
    cschema = "project string, file string, date timestamp"
    rnd = random.Random(7)
    writes = [("p", "claude", f"s{i}", f"f{i % 6}", T0 + timedelta(hours=rnd.randint(0, 200))) for i in range(24)]
    commits = [("p", f"f{rnd.randint(0, 7)}", T0 + timedelta(hours=rnd.randint(0, 260))) for _ in range(10)]
    late = T0 + timedelta(days=400)
    slack = timedelta(minutes=K.TIME_SLACK_MINUTES)
    want = {w: any(c[1] == w[3] and w[4] - slack <= c[2] <= w[4] + timedelta(days=7) for c in commits) for w in writes}
    assert len(set(want.values())) == 2
    # without a deadline in reach this is the batch's landed
    sessions = spark.createDataFrame([(*w[:3], w[4]) for w in writes], "project string, source string, session_id string, started timestamp")
    wrote = spark.createDataFrame([(*w[:4], "write") for w in writes], "project string, source string, session_id string, file string, mode string")
    batch = {(r.session_id, r.file): r.landed for r in drift.drift_files(sessions, wrote, spark.createDataFrame(commits, cschema)).collect()}
    for n, days in enumerate((7, 100)):
        rnd.shuffle(writes)
        rnd.shuffle(commits)
        end_w = [("p", "claude", "end", "z", late), ("p", "claude", "end", "y", late + timedelta(days=200))]
        end_c = [("p", "w", late), ("p", "v", late + timedelta(days=200))]
        stream = jobs.drift_flags(stream_of(spark, tmp_path / f"w{n}", writes * 2 + end_w, wschema, 5), stream_of(spark, tmp_path / f"c{n}", commits + end_c, cschema, 4), days, "30 days")
        rows = [r for r in run(stream, f"drift_flags{n}").collect() if r.session_id != "end"]
        assert len(rows) == len(writes)
        got = {(r.session_id, r.file): r.landed for r in rows}
        assert got == (batch if days == 100 else {(w[2], w[3]): v for w, v in want.items()})


def test_align_matches_equal_batch(spark, tmp_path):
    """Both sides arrive as streams; matches known by time first and by files later come out once, as high."""
    rnd = random.Random(11)
    sessions = [("p", "claude", f"s{i}", t, t + timedelta(hours=rnd.randint(0, 12)), [f"f{k}" for k in rnd.sample(range(8), 2)])
                for i in range(12) for t in [T0 + timedelta(hours=rnd.randint(0, 90))]]
    commits = [("p", f"c{i}", T0 + timedelta(hours=rnd.randint(0, 100)), [f"f{k}" for k in rnd.sample(range(8), 2)]) for i in range(15)]
    sschema = "project string, source string, session_id string, started timestamp, ended timestamp, files array<string>"
    cschema = "project string, sha string, date timestamp, files array<string>"
    s, c = spark.createDataFrame(sessions, sschema), spark.createDataFrame(commits, cschema)
    batch = align.align(c, c.select("project", "sha", F.explode("files").alias("file")), s, s.select(*align.SESSION, F.explode("files").alias("file"), F.lit("write").alias("mode")))
    want = sorted((r.sha, r.session_id, tuple(r.overlap), r.confidence) for r in batch.collect())
    end = T0 + timedelta(days=300)
    for n in range(2):
        rnd.shuffle(sessions)
        rnd.shuffle(commits)
        left = stream_of(spark, tmp_path / f"c{n}", [*commits, ("q", "end", end, []), ("q", "end2", end + timedelta(days=90), [])], cschema, 4)
        right = stream_of(spark, tmp_path / f"s{n}", [*sessions, ("q", "x", "end", end, end, []), ("q", "x", "end2", end + timedelta(days=90), end + timedelta(days=90), [])], sschema, 3)
        rows = run(jobs.align_matches(left, right, "10 days", "1 day", "30 days"), f"align_matches{n}").collect()
        got = sorted((r.sha, r.session_id, tuple(r.overlap), r.confidence) for r in rows if not r.sha.startswith("end"))
        assert got == want and {x[3] for x in want} == {"high", "low"}


def test_align_stream(spark, tmp_path):
    commits = [("p", "c%d" % i, T0 + timedelta(hours=i)) for i in range(9)]
    sessions = spark.createDataFrame([("p", "claude", "s", T0 + timedelta(hours=2), T0 + timedelta(hours=4))],
                                     "project string, source string, session_id string, started timestamp, ended timestamp")
    stream = jobs.align_stream(stream_of(spark, tmp_path / "in", commits, "project string, sha string, date timestamp"), sessions)
    got = {tuple(r) for r in run(stream, "align_stream").collect()}
    batch = align.time_pairs(spark.createDataFrame(commits, "project string, sha string, date timestamp"), sessions)
    assert got == {tuple(r) for r in batch.collect()} and len(got) == 3


def test_capsule_timers(spark, tmp_path):
    schema = "capsule_id string, kind string, ts timestamp, open_date string, outcome string"
    day = lambda d: T0 + timedelta(days=d)
    rows = [("a", "sealed", T0, "2024-05-22", None), ("b", "sealed", T0, "2024-05-22", None), ("b", "answered", day(1), None, "已解决"),
            ("a", "sealed", day(2), "2024-06-30", None), ("tick", "answered", day(40), None, "x"), ("tick", "answered", day(40), None, "x"), ("a", "answered", day(41), None, "想多了"),
            ("tick", "answered", day(42), None, "x"), ("tick", "answered", day(43), None, "x")]
    table = run(jobs.capsule_timers(stream_of(spark, tmp_path / "in", rows, schema, 9)), "capsule_timers")
    got = [(r.capsule_id, r.event, r.at) for r in table.collect()]
    assert sorted(got) == [("a", "answered", "想多了"), ("a", "opened", "2024-05-22"), ("b", "answered", "已解决")]


def test_capsule_answers_may_come_before_seals(spark, tmp_path):
    schema = "capsule_id string, kind string, ts timestamp, open_date string, outcome string"
    seal = [(c, "sealed", T0, "2024-05-22", None) for c in "abc"]
    answers = [(c, "answered", T0 + timedelta(minutes=5), None, "已解决") for c in "abc"]
    for n, rows in enumerate(([*answers, *seal], [*seal, *answers], [answers[0], seal[0], seal[1], answers[1], answers[2], seal[2]])):
        table = run(jobs.capsule_timers(stream_of(spark, tmp_path / f"in{n}", rows, schema, 6)), f"capsule_order{n}")
        assert sorted((r.capsule_id, r.event, r.at) for r in table.collect()) == [(c, "answered", "已解决") for c in "abc"]
