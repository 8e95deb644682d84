"""Ranked lexical search that scores each class of equal bags once.

Documents are restricted to the vocabulary of the items: what is left of a text is its bag, the terms of the vocabulary with
their frequencies.  Two documents with equal bags and equal length factors m score the same for every item.  They form a
class, found by hash and verified by comparing the bags themselves.  Frequencies of terms are counted over classes, and
only classes are scored: each task keeps the best classes of every item, and those of all tasks give the best of all.  An item's
best documents all lie in its best classes, in the order of (score, smallest id), so only these are expanded, by
ascending id.

Items are taken in blocks whose vocabulary has at most ``TERMS`` terms (or a single item), so what is sent to the tasks is
bounded however many items there are.  A block is a pass over the bags, never a join of all items with all documents.

Cases: a null or empty text has no terms and is no result; an item without terms, or whose terms no document holds, has no
rows; rows with equal ids are ranked one after the other; a document with a null id stands after all others of its score;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whylake.llm.common import if_small, materialise, table
from whylake.llm.words import ragged, slices

#: In UTF-8, the characters of a term are ASCII digits and letters and all bytes of longer characters.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Documents for an item; terms of a block of items; pairs of a class's term and an item that are added up at a time.
TOP, TERMS, PAIRS = 10, 200_000, 2_000_000
#: Salts of the first round of a choice of the smallest, so that a large class does not meet in one task.
SALTS = 16
LAST = (1 << 63) - 1


def terms(text: str | None) -> list[bytes]:
    """The terms of a text; only A to Z are lower-cased."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def item_terms(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """(item_id, terms): the distinct terms of every item."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[w.decode("utf-8", "surrogatepass") for w in sorted(set(terms(t.as_py())))] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(of, f"item_id {kind}, terms array<string>")


def blocks_of(found: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Items with their ``block``: as few blocks as keep the vocabulary of each within ``most``, or one item."""
    items = found.count()
    n = 1
    while True:
        dealt = found.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(n)))
        held = dealt.select("block", F.explode("terms").alias("term")).groupBy("block").agg(F.count_distinct("term").alias("n"))
        if n >= items or (held.agg(F.max("n")).first()[0] or 0) <= most:
            return dealt, n
        n *= 2


def bags(docs: DataFrame, vocabulary: list[str], text: str, doc_id: str) -> DataFrame:
    """(doc_id, n, bag): the number of a text's terms, and (place in the vocabulary, frequency) of those in it, packed."""
    sent = docs.sparkSession.sparkContext.broadcast({w.encode("utf-8", "surrogatepass"): i << 32 for i, w in enumerate(vocabulary)})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        for batch in batches:
            for part in slices(batch, 1):
                sizes, found = [], []
                for t in part.column(1):
                    words = terms(t.as_py())
                    sizes.append(len(words))
                    found.append(sorted(place[w] + tf for w, tf in Counter(filter(place.__contains__, words)).items()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "n", "bag"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, f"doc_id {kind}, n long, bag array<long>")


def best_of(found: DataFrame, group: list[str], order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each group, chosen among salted parts of it first."""
    salted = Window.partitionBy(*group, "salt").orderBy(*order)
    first = found.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def scored(classes: DataFrame, weights: dict[int, int], items: list[list[int]], top: int) -> DataFrame:
    """(item, class, first, score): the best classes of every item (its place in ``items``) within each task.

    ``items`` holds places of the vocabulary.  Sums stay below 2^53 and are exact: see ``weigh``.
    """
    held = [(t, i) for i, own in enumerate(items) for t in own if weights.get(t)]
    held.sort()
    wide = max((t for t, _ in held), default=-1) + 1
    sizes = np.bincount(np.array([t for t, _ in held], np.int64), minlength=wide)
    weight = np.zeros(wide, np.int64)
    for t, w in weights.items():
        if t < wide:
            weight[t] = w
    sent = classes.sparkSession.sparkContext.broadcast((sizes, np.array([i for _, i in held], np.int64), weight, len(items)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, posting, weight, n_items = sent.value
        best = np.zeros((0, 4), np.int64)  # item, score, first, class
        floor = np.zeros(n_items, np.int64)  # what a class must reach, once an item has enough
        for batch in batches:
            ids, first, m = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            flat = np.asarray(lists.flatten())
            offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
            term, tf = flat >> 32, flat & 0xFFFFFFFF
            owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
            used = np.flatnonzero(term < len(sizes))
            used = used[sizes[term[used]] > 0]
            term, tf, owner = term[used], tf[used], owner[used]
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
            # whole classes whose pairs with items fit in one step
            pairs = np.bincount(owner, weights=sizes[term], minlength=len(ids)).astype(np.int64)
            step = np.maximum(np.cumsum(pairs) // PAIRS, np.arange(len(ids)) * n_items // (4 * PAIRS))
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(ids)]
            starts = np.searchsorted(owner, edges)
            for lo, hi, a, b in zip(edges, edges[1:], starts, starts[1:], strict=False):
                if a == b:
                    continue
                own = sizes[term[a:b]]
                at = np.repeat(owner[a:b] - lo, own) * n_items + ragged(sizes, posting, term[a:b])
                total = np.bincount(at, weights=np.repeat(value[a:b], own), minlength=(hi - lo) * n_items)
                hit = np.flatnonzero(total)
                item, score = hit % n_items, total[hit].astype(np.int64)
                good = score >= floor[item]
                hit, item, score = hit[good], item[good], score[good]
                row = hit // n_items + lo
                best = np.concatenate([best, np.stack([item, score, first[row], ids[row]], axis=1)])
                best = best[np.lexsort((best[:, 3], best[:, 2], -best[:, 1], best[:, 0]))]
                began = np.searchsorted(best[:, 0], np.arange(n_items + 1))
                best = best[np.arange(len(best)) - began[best[:, 0]] < top]
                count = np.bincount(best[:, 0], minlength=n_items)
                least = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(least, best[:, 0], best[:, 1])
                floor = np.where(count >= top, least, 0)
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best[:, i]) for i in (0, 3, 2, 1)], names=["item", "class", "first", "score"])

    return classes.select("class", "first", "m", "bag").mapInArrow(of, "item long, class long, first long, score long")


def weigh(n_docs: int, holding: int) -> int:
    """The weight of a term.  A score is a sum of weights times less than 10^6, far below 2^53 for a million terms."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def ranked(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
           top: int = TOP, most_terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item.  Document ids are longs."""
    spark = docs.sparkSession
    asked, n_blocks = blocks_of(materialise(item_terms(items, item_text, item_id)), most_terms)
    asked, out = materialise(asked.withColumn("item", F.monotonically_increasing_id())), None
    for block in range(n_blocks):
        own = asked.where(F.col("block") == block).orderBy("item").select("item", "terms").collect()  # bounded by ``most_terms``
        found = of_block(docs, [r.terms for r in own], text, doc_id, top)
        found = found.join(spark.createDataFrame([(i, r.item) for i, r in enumerate(own)], "place long, item long"), "place").drop("place")
        out = found if out is None else out.union(found)
    return out.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def of_block(docs: DataFrame, asked: list[list[str]], text: str, doc_id: str, top: int) -> DataFrame:
    """(place, rank, doc_id, score) for the items of one block, by their place in ``asked``."""
    vocabulary = sorted(set().union(*asked)) if asked else []
    place = {w: i for i, w in enumerate(vocabulary)}
    rows = materialise(bags(docs, vocabulary, text, doc_id).where("n > 0"))
    n_docs, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {max(length, 1)}L")
    rows = rows.where(F.size("bag") > 0).select("doc_id", m.alias("m"), "bag").withColumn("hash", F.xxhash64("m", "bag"))
    # grouped by the bags themselves: an equal hash alone makes no class
    classes = rows.groupBy("hash", "m", "bag").agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("first"), F.count(F.lit(1)).alias("members"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()))
    holding = classes.select("members", F.explode("bag").alias("t")).groupBy(F.shiftright("t", 32).alias("t")).agg(F.sum("members").alias("df"))
    weights = {r.t: weigh(n_docs, r.df) for r in holding.collect()}  # a row for each term of the vocabulary at most
    order = [F.desc("score"), F.asc("first"), F.asc("class")]
    winners = materialise(best_of(scored(classes, weights, [[place[w] for w in own] for own in asked], top), ["item"], order, top).drop("rank"))
    won = materialise(classes.join(if_small(winners.select("class").distinct()), "class", "left_semi").select("class", "hash", "m", "bag"))
    members = rows.join(if_small(won), ["hash", "m", "bag"]).select("class", "doc_id")
    members = materialise(best_of(members, ["class"], [F.asc_nulls_last("doc_id")], top).drop("rank"))
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    expanded = winners.join(members, "class").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
    return expanded.select(F.col("item").alias("place"), "rank", "doc_id", "score")


def op11_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS no, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
held AS (SELECT no, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM held),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tf AS (SELECT no, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT no, unnest(w) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY no, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, total GROUP BY term),
part AS (
  SELECT a.item_id, tf.no, weight.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * h.n * t.n_docs) // t.length))) AS s
  FROM asked a JOIN tf ON tf.term = a.term JOIN weight ON weight.term = a.term JOIN held h ON h.no = tf.no, total t),
score AS (SELECT item_id, no, CAST(sum(s) AS BIGINT) AS score FROM part GROUP BY item_id, no HAVING sum(s) > 0),
placed AS (
  SELECT s.item_id, h.doc_id, s.score, CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, h.doc_id ASC NULLS LAST) AS INTEGER) AS rank
  FROM score s JOIN held h ON h.no = s.no)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
