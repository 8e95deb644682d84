"""State tables: the rows a table holds after a write.

Each function is a plan from the present rows and the incoming ones to the rows to store; writing is
``sinks.replace_partitions`` or an append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions.redact import redact_columns
from whylake.operators.ranking import top_n


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Keep the newest row per key.  A max_by aggregation combines on the map side, unlike a window."""
    columns = current.columns
    both = current.unionByName(incoming)
    order = F.struct(*version) if len(version) > 1 else version[0]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return newest.select("_row.*")


def insert_only(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append when what is stored must not change."""
    return incoming.join(current.select(*keys), keys, "left_anti")


def put_narratives(current: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """Narratives are immutable per commit unless forced.  Incoming text is redacted before it is stored."""
    safe = redact_columns(incoming)
    if force:
        return upsert(current, safe, ["project", "sha"], [F.col("created_at")])
    return current.unionByName(insert_only(current, safe, ["project", "sha"]))


def fill_evidence(narratives: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add evidence where a narrative has none; everything else stays.  ``patched`` tells which rows changed.
    ``evidence`` is (project, sha, n_new)."""
    joined = narratives.join(evidence.select("project", "sha", "n_new"), ["project", "sha"], "left")
    patched = (F.col("n_evidence") == 0) & (F.coalesce("n_new", F.lit(0)) > 0)
    return joined.withColumn("patched", patched).withColumn(
        "n_evidence", F.when(F.col("patched"), F.col("n_new")).otherwise(F.col("n_evidence"))).drop("n_new")


RECORD = "struct<session_id:string,source:string,ts:timestamp_ntz,confidence:string,prompts:array<string>,excerpts:array<string>>"


def merge_evidence(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Evidence records of each commit after a write: (project, sha, evidence, provenance).

    ``stored`` is (project, sha, evidence), records in their order; ``incoming`` has one record a row (project, sha and the
    fields of a record).  A record is known by its session and time: one that is stored already keeps its place and takes the
    newer words, others follow in order of time.  ``provenance`` says of each whether it was ``stored``, ``renewed`` or ``added``.
    """
    fields = ["session_id", "source", "ts", "confidence", "prompts", "excerpts"]
    old = stored.select("project", "sha", F.posexplode("evidence").alias("_place", "_old"))
    new = incoming.groupBy("project", "sha", "session_id", "ts").agg(F.max(F.struct(*fields)).cast(RECORD).alias("_new"))
    keyed = old.withColumns({"session_id": F.col("_old.session_id"), "ts": F.col("_old.ts")})
    o, n = keyed.alias("o"), new.alias("n")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("project", "sha", "session_id", "ts")]
    both = o.join(n, same[0] & same[1] & same[2] & same[3], "full").select(
        F.coalesce("o.project", "n.project").alias("project"), F.coalesce("o.sha", "n.sha").alias("sha"), "_place",
        F.coalesce("o.ts", "n.ts").alias("_ts"), F.coalesce("o.session_id", "n.session_id").alias("_session"),
        F.coalesce("_new", F.col("_old").cast(RECORD)).alias("record"),
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "stored").otherwise("renewed").alias("how"))
    # few records a commit: two from each write
    listed = both.groupBy("project", "sha").agg(F.array_sort(F.collect_list(
        F.struct(F.coalesce("_place", F.lit(1 << 30)).alias("p"), "_ts", "_session", "record", "how"))).alias("all"))
    return listed.select("project", "sha", F.col("all.record").alias("evidence"), F.col("all.how").alias("provenance"))


def judgments(rows: DataFrame) -> DataFrame:
    """Newest judgement per card, keyed by a hash so the project path cannot be read back."""
    keyed = rows.withColumn("project_key", F.sha2("project", 256)).drop("project")
    newest = keyed.groupBy("project_key", "card_id").agg(
        F.max_by(F.struct("status", "action_changed", "elapsed_seconds", "updated_at"), F.struct("updated_at", "judgment_id")).alias("j"))
    return newest.select(
        "project_key", "card_id", "j.*",
        ((F.col("j.status") == K.JUDGMENT_OUTCOMES[0]) & F.coalesce(F.col("j.action_changed"), F.lit(False))).alias("verified_interception"))


def rekey(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move rows from old project keys to new ones.  ``mapping`` is (old, new)."""
    return table.join(mapping, F.col("project") == F.col("old"), "left").withColumn(
        "project", F.coalesce("new", "project")).drop("old", "new")


def distinct_projects(*tables: DataFrame) -> DataFrame:
    """Absolute project paths known to any of the tables.  Each side is reduced before the union."""
    parts = [t.filter(F.startswith("project", F.lit("/"))).select("project").distinct() for t in tables]
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result.distinct()


def unindexed(narratives: DataFrame, indexed: DataFrame) -> DataFrame:
    """Commit narratives missing from the search index; derived rows (keys with a colon) never belong there."""
    return narratives.filter(~F.contains("sha", F.lit(":"))).join(indexed.select("sha"), "sha", "left_anti")


def history_of(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` turns of each conversation, numbered from the end."""
    return top_n(turns, ["session_id"], [F.col("ts").desc(), F.col("turn_id").desc()], n, "from_end")


def put_sessions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Session summaries by (source, session_id): ids of different tools never meet."""
    return upsert(current, redact_columns(incoming), ["source", "session_id"], [F.col("ended"), F.col("records")])


def put_daily(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(current, redact_columns(incoming, ["overview", "decision"]), ["project", "day"], [F.col("created_at")])


def mark_reviewed(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(current, incoming, ["project", "sha"], [F.col("reviewed_at")])


def save_turns(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Conversation turns by turn_id, redacted on the way in."""
    return upsert(current, redact_columns(incoming, ["text"]), ["turn_id"], [F.col("ts")])


def refresh_postings(index: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Search postings after documents (doc_key) changed: their old rows go, the new ones come."""
    return index.join(changed.select("doc_key").distinct(), "doc_key", "left_anti").select(*index.columns).unionByName(fresh)
