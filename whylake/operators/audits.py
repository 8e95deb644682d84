"""Checks that what is shown is really in the records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions import notes
from whylake.functions.redact import redact
from whylake.session import cut_lineage, spread

COMMIT = ["project", "sha"]


def audit_notes(commits: DataFrame, narratives: DataFrame) -> DataFrame:
    """Every decision and watch note of a narrated commit, and whether the stored narrative repeats it word for word."""
    stored = narratives.select(*COMMIT, "decisions", "risks")
    body = F.col("body")
    joined = commits.select(*COMMIT, "body").join(stored, COMMIT)
    expected = F.concat(
        F.transform(notes.redacted_list(notes.decisions(body)), lambda x: F.struct(
            F.lit("decision").alias("kind"), x.alias("text"), F.array_contains("decisions", x).alias("verified"))),
        F.transform(notes.redacted_list(notes.watches(body)), lambda x: F.struct(
            F.lit("risk").alias("kind"), x.alias("text"), F.array_contains("risks", x).alias("verified"))))
    return joined.select(*COMMIT, F.explode(expected).alias("n")).select(*COMMIT, "n.*")


#: Lengths of the windows by which quotes are looked up: the greatest power of two that fits twice.
WINDOWS = (1, 2, 4, 8, 16, 32, 64)


def audit_quotes(quotes: DataFrame, live: DataFrame) -> DataFrame:
    """Stored quotes (quote_id, session_id, quote) against the present text of their session.

    ``live`` is (session_id, texts) with any number of rows per session, each a stretch of its turns, so that a long
    session is never one row.  A quote may have been shortened in the middle, so each of its parts has to be there; a
    session that is gone leaves the quote dangling.

    Texts are cut into windows of w characters, one after the other; a part of at least 2 w - 1 characters that occurs holds one of
    them whole, beginning at one of its first w characters.  So parts meet stretches by hashes of windows, and only where they
    meet are they compared.
    """
    hay = cut_lineage(live.select("session_id", F.monotonically_increasing_id().alias("_stretch"), F.array_join(F.transform("texts", redact), "\n").alias("_hay")))
    alive = live.select("session_id", F.lit(True).alias("_alive")).distinct()
    parts = F.array_distinct(F.filter(F.transform(F.split("quote", "…"), lambda p: F.trim(p)), lambda p: p != ""))
    wanted = quotes.select("quote_id", "session_id", "quote", F.explode(parts).alias("_part"))
    asked = wanted.select("session_id", "_part").distinct().withColumn("_w", F.coalesce(
        *(F.when(F.length("_part") >= 2 * w - 1, F.lit(w)) for w in reversed(WINDOWS))))
    begins = F.transform(F.sequence(F.lit(1), F.col("_w")), lambda i: F.xxhash64(F.substr("_part", i, F.col("_w"))))
    needles = asked.select("session_id", "_part", "_w", F.explode(F.array_distinct(begins)).alias("_h"))
    # each window by one pass of a pattern, which is linear in the text where substring() at every place would not be
    cut = F.coalesce(*(F.when(F.col("_w") == w, F.regexp_extract_all("_hay", F.lit(f"(?s).{{{w}}}"), F.lit(0))) for w in WINDOWS))
    lengths = asked.select("session_id", "_w").distinct()
    windows = hay.join(lengths, "session_id").select("session_id", "_stretch", "_w", F.explode(F.array_distinct(F.transform(cut, lambda x: F.xxhash64(x)))).alias("_h"))
    places = needles.join(windows, ["session_id", "_w", "_h"]).select("session_id", "_part", "_stretch").distinct()
    met = places.join(hay, ["session_id", "_stretch"]).filter(F.contains("_hay", "_part")).select("session_id", "_part").distinct()
    found = wanted.join(met, ["session_id", "_part"]).groupBy("quote_id", "session_id", "quote").agg(F.count(F.lit(1)).alias("_found"))
    judged = quotes.select("quote_id", "session_id", "quote", F.size(parts).alias("_parts")).join(alive, "session_id", "left").join(
        found, ["quote_id", "session_id", "quote"], "left")
    good = (F.col("_parts") > 0) & (F.coalesce("_found", F.lit(0)) == F.col("_parts"))
    return judged.select("quote_id", "session_id", F.when(F.col("_alive").isNull(), "dangling").when(good, "verified").otherwise("mismatch").alias("result"))


def ghost_files(narratives: DataFrame, files: DataFrame) -> DataFrame:
    """File names a narrative (project, sha, text, degraded) mentions that no commit of its project ever touched."""
    named = narratives.select(*COMMIT, F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit(K.GHOST_PATH_PATTERN), F.lit(0)))).alias("mention"))
    named = named.withColumn("base", F.element_at(F.split("mention", "/"), -1))
    bases = files.select("project", F.element_at(F.split("file", "/"), -1).alias("base")).distinct()
    return named.join(bases, ["project", "base"], "left_anti").select(*COMMIT, "mention")


def ghost_summary(narratives: DataFrame, ghosts: DataFrame) -> DataFrame:
    degraded = F.col("degraded") | F.contains("text", F.lit(K.DEGRADED_MARKS[0])) | F.contains("text", F.lit(K.DEGRADED_MARKS[1]))
    flagged = ghosts.groupBy(*COMMIT).agg(F.count(F.lit(1)).alias("_g"))
    return narratives.join(flagged, COMMIT, "left").groupBy("project").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(degraded).alias("degraded"), F.count("_g").alias("ghosted"),
        F.count_if(F.col("_g").isNull()).alias("clean"))


def real_why(commits: DataFrame) -> DataFrame:
    """The recorded why of commits that have one: decisions, then rejected paths marked as such."""
    body = F.col("body")
    marked = F.transform(notes.rejected(body), lambda r: F.concat(F.lit("(否决)"), r))
    rows = commits.withColumn("why", F.array_join(F.concat(notes.decisions(body), marked), "\n"))
    return rows.filter("why <> ''")


# --- quotes inside longer texts: Arrow batches of already paired rows -------------------

def _matching(a: str, b: str, least: int) -> list[tuple[int, int]]:
    """(place in a, size) of the matching blocks of at least ``least`` characters, as difflib finds them: the longest
    first (the earliest of equal ones), then the same to its left and right.

    Only places that share ``least`` characters are looked at, and a stretch without any ends the search in it.
    """
    seeds: dict[str, list[int]] = {}
    for j in range(len(b) - least + 1):
        seeds.setdefault(b[j:j + least], []).append(j)
    starts = [(i, seeds[a[i:i + least]]) for i in range(len(a) - least + 1) if a[i:i + least] in seeds]
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo and starts:
        alo, ahi, blo, bhi = todo.pop()
        best, at, other = 0, 0, 0
        for i, places in starts:
            if i < alo or i + least > ahi:
                continue
            for j in places:
                if j < blo or j + least > bhi or (i > alo and j > blo and a[i - 1] == b[j - 1]):
                    continue
                size = least
                while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                    size += 1
                if size > best:
                    best, at, other = size, i, j
        if best:
            found.append((at, best))
            todo += [(alo, at, blo, other), (at + best, ahi, other + best, bhi)]
    return sorted(found)


def leakage(pairs: DataFrame, min_block: int = 4) -> DataFrame:
    """Share of the characters of ``why`` that occur in ``diff`` in runs of at least ``min_block``."""

    @F.pandas_udf("double")
    def ratio(why: pd.Series, diff: pd.Series) -> pd.Series:
        def one(w, d):
            if not w:
                return 0.0
            return sum(size for _, size in _matching(w, d or "", min_block)) / len(w)

        return pd.Series([one(w, d) for w, d in zip(why, diff)], dtype="float64")

    return spread(pairs, *COMMIT).withColumn("ratio", ratio("why", "diff"))


def leakage_bands(scored: DataFrame) -> DataFrame:
    band = F.when(F.col("ratio") >= 0.6, "contained").when(F.col("ratio") >= 0.25, "partial").otherwise("absent")
    return scored.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("commits"))


def cleanest(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy("ratio", F.col("log_pos").desc(), "sha").limit(n)


HIGHLIGHT_SCHEMA = "answer_id string, position int, text string, cite_id int"


def highlight(answers: DataFrame, min_span: int = 6) -> DataFrame:
    """Answers (answer_id, answer, citations: array<struct<cite_id, verbatim>>) cut into spans; a span that repeats a
    citation word for word carries its id, and all spans of an answer together are the answer.  Longer matches win
    at the same place; matches do not overlap; an answer without any match gives no rows."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                answer = row.answer or ""
                found = []
                for cite in row.citations if row.citations is not None else []:
                    text = cite["verbatim"] or ""
                    found += [(at, -size, cite["cite_id"]) for at, size in _matching(answer, text, min_span)]
                place, at = 0, 0
                for start, size, cite in sorted(found):
                    if start < at:
                        continue
                    if start > at:
                        rows.append((row.answer_id, place, answer[at:start], None))
                        place += 1
                    rows.append((row.answer_id, place, answer[start:start - size], cite))
                    place, at = place + 1, start - size
                if at and at < len(answer):
                    rows.append((row.answer_id, place, answer[at:], None))
            out = pd.DataFrame(rows, columns=["answer_id", "position", "text", "cite_id"])
            out["cite_id"] = out["cite_id"].astype("Int32")
            yield out

    return spread(answers.select("answer_id", "answer", "citations"), "answer_id").mapInPandas(cut, HIGHLIGHT_SCHEMA)
