"""Ranked topic search over narratives and conversation turns, and the evidence assembled from its hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions import notes
from whylake.operators.ranking import sieved, top_n
from whylake.operators.rendering import cited_sources, render_hit, verbatim_text
from whylake.session import cut_lineage, spread


def body_of(why: Column, decisions: Column) -> Column:
    """What is searchable of a narrative: the why and its decisions."""
    told = F.when(F.trim(F.coalesce(why, F.lit(""))) != "", why)
    return F.concat_ws("\n", told, F.array_join(F.filter(notes.texts_or_empty(decisions), lambda d: F.trim(d) != ""), "\n"))


def grams(text: Column, n: int = 3) -> Column:
    """All overlapping n-grams of a text, folded to lower case.

    One zero-width regex pass over the text: linear in its length, where substring() per place would be quadratic.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))


def gram_counts(rows: DataFrame, keep: list[str], found: Column) -> DataFrame:
    """The columns ``keep`` of ``rows``, once for each different gram of ``found``, an array, with (trigram, tf).

    Counted within the row: the sorted array is cut where the gram changes, so no table of all postings is aggregated, which
    would spill many times the size of the texts.
    """
    first = F.transform("_g", lambda x, i: F.when((i == 0) | (F.get("_g", i - 1) != x), i))
    runs = rows.withColumn("_g", F.sort_array(found)).withColumn("_at", F.array_compact(first))
    each = F.transform("_at", lambda a, k: F.struct(
        F.get("_g", a).alias("trigram"), (F.coalesce(F.get("_at", k + 1), F.size("_g")) - a).cast("bigint").alias("tf")))
    return runs.select(*keep, F.inline(each))


def vocabulary(corpus: DataFrame) -> DataFrame:
    """(trigram, documents, occurrences) of a corpus (doc_key, body).  Texts of one key are one document."""
    bodies = spread(corpus.select("doc_key", "body"), "doc_key").groupBy("doc_key").agg(F.collect_list("body").alias("bodies"))
    found = F.flatten(F.transform("bodies", lambda b: grams(b)))
    return gram_counts(bodies, [], found).groupBy("trigram").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


def query_terms(question: Column) -> Column:
    """Words of at least three characters that are no operators, operator characters blanked first."""
    words = F.split(F.regexp_replace(question, K.QUERY_STRIP_PATTERN, " "), r"(?U)\s+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.upper(w).isin(*K.QUERY_KEYWORDS))


def query_trigrams(questions: DataFrame) -> DataFrame:
    """(question_id, project, trigram, times): a phrase that occurs twice in a question counts twice."""
    words = questions.select("question_id", "project", F.explode(query_terms(F.col("text"))).alias("_word"))
    rows = words.select("question_id", "project", F.explode(grams(F.col("_word"))).alias("trigram"))
    return rows.groupBy("question_id", "project", "trigram").agg(F.count(F.lit(1)).alias("times"))


def postings(corpus: DataFrame) -> DataFrame:
    """The inverted index: (trigram, doc_key, project, tf, len).  ``corpus`` is (doc_key, project, kind, body).

    Texts are hashed by document first, which already satisfies the counting per document: the texts are shuffled once
    and the many times larger postings never are.  Write the result bucketed by trigram.
    """
    return _occurrences(corpus).groupBy("trigram", "doc_key", "project", "len").agg(F.count(F.lit(1)).alias("tf"))


def _occurrences(corpus: DataFrame) -> DataFrame:
    return spread(corpus.select("doc_key", "project", "body"), "doc_key").select(
        "doc_key", "project", F.greatest(F.length("body") - 2, F.lit(0)).alias("len"), F.explode(grams(F.col("body"))).alias("trigram"))


def bm25_part(tf: Column, length: Column, average: Column) -> Column:
    """What a term adds to a score before its weight: more for a higher frequency, less in a longer text."""
    return tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * length / average))


def term_weights(wanted: DataFrame, frequency: DataFrame, total: Column) -> DataFrame:
    """(question_id, _only, trigram, weight) of the trigrams asked for, by the documents (trigram, df) that hold them."""
    idf = F.ln((total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return wanted.join(frequency, "trigram").withColumn(
        "weight", F.col("times") * F.when(idf <= 0, K.BM25_IDF_FLOOR).otherwise(idf)).select(
        "question_id", F.col("project").alias("_only"), "trigram", "weight")


def search(corpus: DataFrame, questions: DataFrame, limit: int = K.SEARCH_LIMIT, index: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` documents per question (question_id, project or NULL for all, text), by BM25.

    Statistics cover the whole corpus; the project only filters hits.  Only trigrams that some question asks for leave
    the scan: a bitmap of these is asked before anything is shuffled.
    """
    wanted = query_trigrams(questions)
    terms = wanted.select("trigram").distinct()
    stats = corpus.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(F.greatest(F.length("body") - 2, F.lit(0))).alias("avg_len")).select(F.struct("n", "avg_len")).scalar()
    if index is None:
        matched = sieved(_occurrences(corpus), ["trigram"], terms).join(terms, "trigram").groupBy("trigram", "doc_key", "project", "len").agg(F.count(F.lit(1)).alias("tf"))
    else:
        matched = index.join(terms, "trigram", "left_semi")
    matched = cut_lineage(matched)  # only the postings asked for; read for their frequencies and again for the scores
    frequency = matched.groupBy("trigram").agg(F.count(F.lit(1)).alias("df"))
    total, average = stats["n"], stats["avg_len"]
    weights = term_weights(wanted, frequency, total)
    # the part of the score that does not depend on the question, once per posting
    scored = matched.withColumn("_s", bm25_part(F.col("tf"), F.col("len"), average)).join(weights, "trigram").filter(
        F.col("_only").isNull() | (F.col("_only") == F.col("project")))
    totals = scored.groupBy("question_id", "doc_key").agg(F.sum(F.col("_s") * F.col("weight")).alias("score"))
    # ties (equal to nine digits, so that summation order cannot matter) go by key
    return top_n(totals, ["question_id"], [F.round("score", 9).desc(), F.col("doc_key")], limit)


def two_character_fallback(corpus: DataFrame, questions: DataFrame, ranked: DataFrame, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """For questions without any ranked hit: documents that contain one of their isolated two-character CJK words.
    Matching goes through the character pairs of both sides, an equi-join."""
    missed = questions.join(ranked.select("question_id").distinct(), "question_id", "left_anti")
    words = missed.select("question_id", F.col("project").alias("_only"), F.explode(
        F.regexp_extract_all("text", F.lit(K.TWO_CJK_PATTERN), F.lit(0))).alias("pair")).distinct()
    pairs = corpus.select("doc_key", "project", F.explode(F.array_distinct(
        F.regexp_extract_all("body", F.lit("(?=([一-鿿]{2}))"), F.lit(1)))).alias("pair"))
    hits = pairs.join(words, "pair").filter(F.col("_only").isNull() | (F.col("_only") == F.col("project")))
    return top_n(hits.select("question_id", "doc_key").distinct(), ["question_id"], [F.col("doc_key")], limit)


def hits(ranked: DataFrame, corpus: DataFrame, segments: DataFrame) -> DataFrame:
    """Ranked keys with the record behind them: a commit with its notes, or a conversation turn.
    ``segments`` comes from ``history.segments``."""
    known = ranked.join(corpus.select("doc_key", "kind", "body"), "doc_key")
    recorded = segments.select(F.col("sha").alias("doc_key"), "why", "decisions", "rejected")
    talk = F.col("kind") == "conversation"
    joined = known.join(recorded, "doc_key", "left")
    blank = F.array().cast("array<string>")
    return joined.select(
        "question_id", "rank", F.col("doc_key").alias("sha"), "kind", F.when(talk, F.col("body")).otherwise("").alias("text"),
        F.when(talk, "").otherwise(F.coalesce("why", F.lit(""))).alias("why"),
        F.when(talk, blank).otherwise(notes.texts_or_empty(F.col("decisions"))).alias("decisions"),
        F.when(talk, blank).otherwise(notes.texts_or_empty(F.col("rejected"))).alias("rejected"))


def with_references(hit_rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Hits with the evidence, tests and requests stored for their commit (sha, evidence, test_refs, pr_refs)."""
    return hit_rows.join(refs.select("sha", "evidence", "test_refs", "pr_refs"), "sha", "left")


def reference_rows(history: DataFrame, refs: DataFrame) -> DataFrame:
    """Evidence, tests and requests behind the history of each target, every one once, by first occurrence: evidence
    by session and time, tests by path, requests by number.  Order by (log_pos, pos)."""
    rows = cut_lineage(history.select("target", "sha", "log_pos").join(refs, "sha"))  # read once for each kind
    parts = []
    for kind, column, key in (
        ("evidence", "evidence", lambda x: F.concat_ws("|", x["session_id"], x["ts"].cast("string"))),
        ("test", "test_refs", lambda x: x["path"]), ("request", "pr_refs", lambda x: x["number"].cast("string"))):
        item = rows.select("target", "log_pos", F.posexplode(column).alias("pos", "x"))
        parts.append(item.select("target", F.lit(kind).alias("kind"), key(F.col("x")).alias("key"), "log_pos", "pos", F.to_json("x").alias("item")))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return first_seen(both, ["target", "kind", "key"], [F.col("log_pos"), F.col("pos")])


def hit_kinds(hit_rows: DataFrame) -> DataFrame:
    return hit_rows.groupBy("question_id").agg(
        F.count_if(F.col("kind") == "commit").alias("commits"), F.count_if(F.col("kind") == "conversation").alias("conversations"))


def first_seen(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first to arrive."""
    return top_n(rows, keys, order, 1, "_first").drop("_first")


def assemble(topic_hits: DataFrame, line_hits: DataFrame) -> DataFrame:
    """Citations of each question: topic hits first, then the history of its target, each commit once.

    Text given to a reader and the citation come from the same row.  A question has at most 8 + 50 rows.
    """
    both = topic_hits.withColumn("part", F.lit(0)).unionByName(line_hits.withColumn("part", F.lit(1)))
    unique = first_seen(both, ["question_id", "sha"], [F.col("part"), F.col("rank")])
    numbered = top_n(unique, ["question_id"], [F.col("part"), F.col("rank")], K.SEARCH_LIMIT + K.HISTORY_LIMIT, "place")
    return numbered.select(
        "question_id", (F.col("place") - 1).alias("cite_id"), "sha", "kind", render_hit().alias("evidence"),
        verbatim_text().alias("verbatim"), cited_sources().alias("sources"))


def material(citations: DataFrame, no_material: str) -> DataFrame:
    """All evidence of a question as one bounded text; also the answer when no model is asked."""
    return citations.groupBy("question_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("cite_id", "evidence"))), lambda x: x["evidence"]), "\n\n").alias("material")).withColumn(
        "material", F.coalesce(F.nullif("material", F.lit("")), F.lit(no_material)))


def verify_cited(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Keep citations (question_id, cited) that are a prefix of a retrieved SHA, or the other way round.
    A question retrieves at most fifty SHAs, so they travel as one array."""
    known = retrieved.groupBy("question_id").agg(F.collect_set("sha").alias("_shas"))
    joined = cited.join(known, "question_id")
    either = F.exists("_shas", lambda s: F.startswith(s, F.col("cited")) | F.startswith(F.col("cited"), s))
    return joined.filter(either).drop("_shas")
