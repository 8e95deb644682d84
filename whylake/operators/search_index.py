"""The stored search index: posting lists in blocks of neighbouring documents, with a bound for each block.

Documents are numbered in order of (project, key) and cut into ranges of ``RANGE``.  A block holds the postings of one trigram in
one range: places inside the range and frequencies, besides the greatest frequency and the least length, from which follows what
the trigram can add to the score of any document there, whatever the average length has become.  A search reads these heads,
adds the bounds of its trigrams range by range, scores the most promising ranges, and reads of all others only those
whose bound reaches the score of the last hit so far.  The result is that of a scan.

New documents are ranges of their own behind the old ones, and removed ones are named in a table, together with how many of
them held each trigram, so frequencies stay exact; nothing is rebuilt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.operators.ranking import numbered, top_n
from whylake.operators.search import bm25_part, gram_counts, grams, query_trigrams, term_weights
from whylake.session import cut_lineage

RANGE = 1024
#: Ranges that are scored first for each question.
FIRST = 2

_SCHEMAS = {
    "documents": "block bigint, offset int, doc_key string, project string, len int",
    "blocks": "trigram string, block bigint, n int, max_tf bigint, min_len int, offsets array<smallint>, tfs array<bigint>",
    "removed": "block bigint, offset int, len int",
    "lost": "trigram string, n bigint",
}


@dataclass
class Index:
    """A folder that all executors share."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.select(*(c.split()[0] for c in _SCHEMAS[name].split(", "))).write.mode("append").parquet(f"{self.folder}/{name}")

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> Index:
        index = cls(spark, folder)
        for name, schema in _SCHEMAS.items():
            spark.createDataFrame([], schema).write.mode("errorifexists").parquet(f"{folder}/{name}")
        return index

    def add(self, corpus: DataFrame) -> None:
        """Documents (doc_key, project, body) as new ranges; a key that is there already has to be removed first.

        Texts are dealt out by range, so the postings, many times larger, are counted where they are made.
        """
        begin = self.table("documents").agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]
        no = numbered(corpus.select("doc_key", "project"), ["project", "doc_key"])
        placed = no.select("doc_key", "project", (F.expr(f"number div {RANGE}") + begin).alias("block"), (F.col("number") % RANGE).cast("int").alias("offset"))
        texts = corpus.select("doc_key", "body").join(placed, "doc_key").withColumn("len", F.greatest(F.length("body") - 2, F.lit(0))).repartition("block")
        postings = gram_counts(texts, ["block", "offset", "len"], grams(F.col("body")))
        lists = postings.groupBy("block", "trigram").agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"),
            F.array_sort(F.collect_list(F.struct(F.col("offset").cast("smallint").alias("offset"), "tf"))).alias("p"))
        blocks = lists.withColumns({"offsets": F.col("p.offset"), "tfs": F.col("p.tf")}).sortWithinPartitions("trigram", "block")
        self._append("blocks", blocks)
        lengths = corpus.select("doc_key", F.coalesce(F.greatest(F.length("body") - 2, F.lit(0)), F.lit(0)).alias("len"))
        self._append("documents", placed.join(lengths, "doc_key").repartitionByRange("block"))

    def remove(self, keys: DataFrame) -> None:
        """Take out the documents of ``keys`` (doc_key).  Only the blocks of their ranges are read."""
        found = cut_lineage(self.live().join(keys.select("doc_key").distinct(), "doc_key", "left_semi").select("block", "offset", "len"))
        ranges = self.table("blocks").join(found.select("block").distinct(), "block", "left_semi")
        held = ranges.select("trigram", "block", F.explode(F.col("offsets").cast("array<int>")).alias("offset")).join(found, ["block", "offset"], "left_semi")
        self._append("lost", cut_lineage(held.groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))))
        self._append("removed", found)

    def live(self) -> DataFrame:
        return self.table("documents").join(self.table("removed").select("block", "offset"), ["block", "offset"], "left_anti")


class _Asked:
    """Questions against an index: weights of their trigrams and bounds of their ranges."""

    def __init__(self, index: Index, questions: DataFrame):
        self.index = index
        self.wanted = query_trigrams(questions)
        self.terms = self.wanted.select("trigram").distinct()
        stats = index.live().agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avg_len")).select(F.struct("n", "avg_len")).scalar()
        self.average = stats["avg_len"]
        heads = cut_lineage(index.table("blocks").select("trigram", "block", "n", "max_tf", "min_len").join(self.terms, "trigram", "left_semi"))
        held = heads.groupBy("trigram").agg(F.sum("n").alias("n")).join(index.table("lost").groupBy("trigram").agg(F.sum("n").alias("lost")), "trigram", "left")
        frequency = held.select("trigram", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("df")).filter("df > 0")
        self.weights = cut_lineage(term_weights(self.wanted, frequency, stats["n"]))
        most = heads.withColumn("_s", bm25_part(F.col("max_tf"), F.col("min_len"), self.average)).join(self.weights, "trigram")
        within = index.table("documents").groupBy("block").agg(F.min("project").alias("_low"), F.max("project").alias("_high"))
        inside = F.col("_only").isNull() | F.col("_only").between(F.col("_low"), F.col("_high"))
        bounds = most.groupBy("question_id", "_only", "block").agg(F.sum(F.col("_s") * F.col("weight")).alias("bound"))
        self.bounds = cut_lineage(bounds.join(within, "block").filter(inside).select("question_id", "block", "bound"))

    def scored(self, pairs: DataFrame) -> DataFrame:
        """(question_id, doc_key, score) of all documents in the ranges of ``pairs`` (question_id, block)."""
        lists = self.index.table("blocks").join(pairs.select("block").distinct(), "block", "left_semi").join(self.terms, "trigram", "left_semi")
        postings = lists.select("trigram", "block", F.inline(F.arrays_zip("offsets", "tfs"))).select(
            "trigram", "block", F.col("offsets").cast("int").alias("offset"), F.col("tfs").alias("tf"))
        known = postings.join(self.index.live(), ["block", "offset"]).withColumn("_s", bm25_part(F.col("tf"), F.col("len"), self.average))
        rows = known.join(self.weights, "trigram").filter(F.col("_only").isNull() | (F.col("_only") == F.col("project")))
        return rows.join(pairs, ["question_id", "block"], "left_semi").groupBy("question_id", "doc_key").agg(F.sum(F.col("_s") * F.col("weight")).alias("score"))

    def best(self, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Scores that hold the best ``limit`` of each question, and the pairs read first and after that."""
        order: list[Column] = [F.round("score", 9).desc(), F.col("doc_key")]
        first = cut_lineage(top_n(self.bounds, ["question_id"], [F.col("bound").desc(), F.col("block")], FIRST).select("question_id", "block"))
        tried = cut_lineage(top_n(self.scored(first), ["question_id"], order, limit))
        least = tried.filter(F.col("rank") == limit).select("question_id", F.col("score").alias("least"))
        others = self.bounds.join(first, ["question_id", "block"], "left_anti").join(least, "question_id", "left")
        # a little below, since sums in another order differ in their last digits
        rest = cut_lineage(others.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select("question_id", "block"))
        both = tried.drop("rank").unionByName(self.scored(rest))
        return top_n(both, ["question_id"], order, limit), first, rest


def search(index: Index, questions: DataFrame, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """The best ``limit`` documents per question (question_id, project or NULL for all, text), as ``search.search`` finds them."""
    return _Asked(index, questions).best(limit)[0]


def ranges_read(index: Index, questions: DataFrame, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """(question_id, ranges, read): in how many ranges the trigrams of a question occur, and how many had to be read."""
    asked = _Asked(index, questions)
    _, first, rest = asked.best(limit)
    read = first.unionByName(rest).groupBy("question_id").agg(F.count(F.lit(1)).alias("read"))
    return asked.bounds.groupBy("question_id").agg(F.count(F.lit(1)).alias("ranges")).join(read, "question_id")
