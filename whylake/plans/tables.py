"""The given tables read in the roles this engine works on.

Orders play commits, line items play changed files and hunks, documents play narratives, events play tool actions of
assistant sessions, conversations play recorded turns.  A project is a block of one hundred customers (or one user),
so the number of projects, not their size, grows with the data.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.operators.ranking import first_texts, sieved


# Stated, so that opening a table starts no job that reads file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
}


# The file a part number stands for, as an SQL text over column m.
FILE_OF_PART = (
    "CASE WHEN m < 3 THEN concat('deps/pkg', m, '.lock') WHEN m < 10 THEN concat('docs/guide', m, '.md') "
    "WHEN m < 25 THEN concat('tests/test_mod', m, '.py') ELSE concat('src/area', m % 7, '/mod', m, '.py') END"
)


# What names a commit, by its order.  It is written out behind joins by order, so that line items meet narrow rows.
PROJECT_OF_ORDER = "concat('/fleet/p', cust div 100) AS project"
SHA_OF_ORDER = "sha1(CAST(key AS STRING)) AS sha"
POSITION_OF_ORDER = "CAST(datediff(date, DATE '1970-01-01') AS BIGINT) * 1000000000000 + key AS log_pos"
COMMIT_OF_ORDER = (PROJECT_OF_ORDER, SHA_OF_ORDER, POSITION_OF_ORDER)
NOTES_OF_ORDER = {
    "dec": "CASE WHEN status = 'F' THEN concat('ship order ', key, ' in one batch') END",
    "watch": "CASE WHEN priority = '1-URGENT' THEN concat('order ', key, ' may exceed budget') END",
    "rej": "CASE WHEN priority = '5-LOW' THEN concat('split order ', key) END",
}


def role(method):
    """A role table is built once per ``Tables``; plans then share the analysed DataFrame."""

    @functools.wraps(method)
    def once(self):
        if method.__name__ not in self._open:
            self._open[method.__name__] = method(self)
        return self._open[method.__name__]

    return once


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        key = f"raw {name}"
        if key not in self._open:
            self._open[key] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        return self._open[key]

    # --- history -----------------------------------------------------------
    @role
    def all_commits(self) -> DataFrame:
        rows = self.raw("orders").selectExpr(
            "concat('/fleet/p', o_custkey div 100) AS project",
            "sha1(CAST(o_orderkey AS STRING)) AS sha",
            "CAST(datediff(o_orderdate, DATE '1970-01-01') AS BIGINT) * 1000000000000 + o_orderkey AS log_pos",
            "o_orderdate AS date", "concat('dev', o_custkey) AS author",
            "concat(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'fix: ' WHEN '2' THEN 'feat(core): ' "
            "WHEN '3' THEN 'refactor: ' WHEN '4' THEN 'Update ' ELSE 'chore: ' END, 'order ', o_orderkey) AS subject",
            "o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' AS is_merge",
            "o_orderkey AS key", "o_custkey AS cust", "o_orderstatus AS status", "o_orderpriority AS priority", "o_totalprice AS price",
        )
        rows = rows.selectExpr("* EXCEPT (key, cust, status, priority, price)", *(f"{what} AS {name}" for name, what in NOTES_OF_ORDER.items()), "key", "cust", "status", "price")
        body = (
            "concat_ws('\\n', concat('Order ', key, ' of customer ', cust), "
            f"concat('{K.NOTE_DECISION} ', dec), concat('{K.NOTE_WATCH} ', watch), concat('{K.NOTE_REJECTED} ', rej)) AS body"
        )
        return rows.selectExpr("*", body).drop("cust")

    @role
    def commits(self) -> DataFrame:
        return self.all_commits().filter("NOT is_merge").drop("dec", "watch", "rej")

    @role
    def _orders(self) -> DataFrame:
        """The orders that are commits, in the columns that ``COMMIT_OF_ORDER`` follows from."""
        return self.raw("orders").filter("NOT (o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM')").selectExpr(
            "o_orderkey AS key", "o_custkey AS cust", "o_orderdate AS date")

    @role
    def files(self) -> DataFrame:
        parts = self.raw("lineitem").selectExpr("l_orderkey AS key", "l_partkey % 100 AS m").distinct()
        return parts.join(self._orders(), "key").selectExpr(*COMMIT_OF_ORDER, "date", f"{FILE_OF_PART} AS file")

    @role
    def tracked(self) -> DataFrame:
        parts = self.raw("lineitem").filter("l_quantity >= 49").selectExpr("l_orderkey AS key", "l_partkey % 100 AS m")
        return parts.join(self._orders(), "key").selectExpr(PROJECT_OF_ORDER, f"{FILE_OF_PART} AS file").distinct()

    @role
    def hunks(self) -> DataFrame:
        lines = self.raw("lineitem").selectExpr(
            "l_orderkey AS key", "l_partkey % 100 AS m", "l_linenumber AS n", "CAST(l_quantity AS BIGINT) AS q")
        return lines.join(self._orders(), "key").selectExpr(
            *COMMIT_OF_ORDER, "date", f"{FILE_OF_PART} AS file", "CAST(n AS BIGINT) * 40 AS new_start", "q AS new_count",
            "CAST(n AS BIGINT) * 40 AS old_start", "q - 1 AS old_count").filter("NOT endswith(file, '.lock')")

    @role
    def renames(self) -> DataFrame:
        """Every 37th order renames a source or test to the next number's name, whole chains of them in time."""
        rows = self.commits().filter("key % 37 = 0").selectExpr("project", "log_pos", "25 + key % 70 AS m")
        named = rows.selectExpr("project", "log_pos", "m + 1 AS m", f"{FILE_OF_PART} AS old")
        return named.selectExpr("project", "log_pos", "old", f"{FILE_OF_PART} AS new")

    # --- narratives and judgements ------------------------------------------
    @role
    def narratives(self) -> DataFrame:
        labels = self.raw("labels").withColumnRenamed("doc_id", "label_id")
        docs = self.raw("documents")
        # only orders that have a document meet the texts, in few columns
        orders = sieved(self.raw("orders"), ["o_orderkey"], docs.select(F.col("doc_id").alias("o_orderkey"))).selectExpr(
            "o_orderkey AS key", "o_custkey AS cust", "o_orderdate AS date", "o_orderstatus AS status", "o_orderpriority AS priority")
        # a document without an order is kept under a project of its own, so that no text is left out of a corpus
        rows = docs.join(orders, F.col("doc_id") == F.col("key"), "left").join(labels, F.col("doc_id") == F.col("label_id"), "left").selectExpr(
            "*", *COMMIT_OF_ORDER, *(f"{what} AS {name}" for name, what in NOTES_OF_ORDER.items()))
        return rows.selectExpr(
            "coalesce(project, concat('/fleet/unfiled', doc_id div 100)) AS project", "coalesce(sha, sha1(concat('d', doc_id))) AS sha",
            "coalesce(log_pos, doc_id) AS log_pos", "coalesce(date, TIMESTAMP_NTZ '1970-01-01') AS date", "doc_id",
            "concat('Order ', doc_id, ' in ', lang) AS what", "text AS why",
            "array_compact(array(CASE WHEN lang = 'en' THEN concat('keep ', source) END, dec)) AS decisions",
            "array_compact(array(watch, CASE WHEN n_chars > 1500 THEN concat('check ', lang, ' copy') END, "
            f"CASE WHEN n_chars < 300 THEN '{K.FILLER_PREFIX},无法判断' END)) AS risks",
            "array_compact(array(CASE WHEN lang IN ('fr', 'es') THEN concat('translate ', source) END, "
            "CASE WHEN n_chars < 300 THEN '  ' END)) AS open_loops",
            "array_compact(array(CASE WHEN lang = 'es' THEN concat('drop ', source) END, rej)) AS rejected",
            "CAST(CASE WHEN quality = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_evidence",
            "coalesce(toxic = 1, false) AS degraded",
            "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, doc_id) AS created_at",
        )

    @role
    def capsules(self) -> DataFrame:
        return self.all_commits().filter("NOT is_merge AND watch IS NOT NULL").selectExpr(
            "concat(sha, ':0') AS capsule_id", "project", "sha", "watch AS risk", "to_date(date) AS sealed_date",
            f"date_add(to_date(date), {K.CAPSULE_DAYS}) AS open_date",
            f"CASE WHEN status <> 'O' THEN date_add(to_date(date), {K.CAPSULE_DAYS}) END AS opened_date",
            f"CASE WHEN status = 'F' THEN '{K.CAPSULE_OUTCOMES[1]}' END AS outcome")

    @role
    def reviewed(self) -> DataFrame:
        return self.commits().filter("price >= 250000").selectExpr(
            "project", "sha", "date + interval 10 days AS reviewed_at")

    @role
    def requests(self) -> DataFrame:
        """Pull requests behind some commits."""
        return self.commits().filter("price BETWEEN 100000 AND 180000 AND key % 3 = 0").selectExpr(
            "project", "sha", "key AS number", "concat('Request ', key) AS title", "concat('wanted by ', author) AS snippet")

    @role
    def evidence(self) -> DataFrame:
        """Evidence records: the conversation behind a narrative whose label says that it is good."""
        said = self.raw("conversations").groupBy("conv_id").agg(
            F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))).alias("asked"),
            F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("told"))
        rows = self.narratives().filter("n_evidence > 0").join(said, F.col("conv_id") == F.col("doc_id"), "left")
        cut = lambda c, n: F.coalesce(F.slice(F.col(f"{c}.text"), 1, n), F.array().cast("array<string>"))
        record = F.struct(
            F.concat(F.lit("c"), "doc_id").alias("session_id"), F.lit("claude").alias("source"), F.col("created_at").alias("ts"),
            F.when(F.size("decisions") > 0, "high").otherwise("low").alias("confidence"), cut("asked", 2).alias("prompts"), cut("told", 1).alias("excerpts"))
        return rows.select("project", "sha", F.array(record).alias("evidence"))

    # --- sessions -------------------------------------------------------------
    @role
    def actions(self) -> DataFrame:
        rows = self.raw("events").filter("event_type <> 'purchase'").selectExpr(
            "*", "get_json_object(props, '$.k') AS k")
        return rows.selectExpr(
            "event_id", "ts",
            "CASE event_type WHEN 'signup' THEN 'cursor' WHEN 'error' THEN 'codex' ELSE 'claude' END AS source",
            "concat('/fleet/u', user_id) AS project",
            "concat(user_id, ':', date_format(ts, 'yyyy-MM-dd')) AS session_id",
            "CASE event_type WHEN 'view' THEN 'read' ELSE 'write' END AS mode",
            "concat('src/k', k, '.py') AS file", "value", "CAST(k AS BIGINT) AS n")

    @role
    def sessions(self) -> DataFrame:
        return self.actions().groupBy("project", "source", "session_id").agg(
            F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("records"))

    @role
    def session_files(self) -> DataFrame:
        return self.actions().select("project", "source", "session_id", "file", "mode").distinct()

    @role
    def session_texts(self) -> DataFrame:
        """What was said in a session, told by the files that it read (asked about) and wrote (stated)."""
        keys = ["project", "source", "session_id"]
        rows = self.session_files()
        asked = first_texts(rows.filter("mode = 'read'"), keys, F.concat(F.lit("what does "), "file", F.lit(" do")), F.col("file"), K.MAX_PROMPTS, "prompts")
        stated = first_texts(rows.filter("mode = 'write'"), keys, F.concat(F.lit("changed "), "file"), F.col("file"), K.MAX_EXCERPTS, "excerpts")
        return asked.join(stated, keys, "full")

    @role
    def event_commits(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'purchase'").selectExpr(
            "concat('/fleet/u', user_id) AS project", "sha1(concat('e', event_id)) AS sha", "event_id AS log_pos",
            "ts AS date", "concat('feat: purchase ', event_id) AS subject",
            "concat('src/k', get_json_object(props, '$.k'), '.py') AS file")

    @role
    def turns(self) -> DataFrame:
        return self.raw("conversations").selectExpr(
            "concat('c', conv_id) AS session_id", "concat('/chat/', conv_id div 50) AS project", "turn AS line_no",
            "role", "text", "concat(conv_id, ':', turn) AS turn_id",
            "TIMESTAMP_NTZ '2024-02-01' + make_dt_interval(0, 0, 0, conv_id * 60 + turn) AS ts")

    @role
    def usage(self) -> DataFrame:
        rows = self.raw("events").selectExpr("*", "CAST(get_json_object(props, '$.k') AS BIGINT) AS n")
        return rows.selectExpr(
            "event_type AS command", "concat('/fleet/u', user_id) AS project", "ts", "n % 3 AS llm_calls",
            "n AS tokens_in", "n * 2 AS tokens_out", "n * 7 AS cache_hit_tokens", "event_id")

    # --- paths ------------------------------------------------------------------
    @role
    def url_paths(self) -> DataFrame:
        return self.raw("pages").selectExpr(
            "page_id", r"regexp_extract(url, r'^https?://([^/?#]+)', 1) AS host",
            r"concat('/', regexp_extract(url, r'^https?://([^?#]+)', 1)) AS path", "url")
