"""I-Match fingerprints with randomised lexicons.

Terms are lower-cased words.  The lexicon keeps the terms whose inverse document frequency lies in a band: neither the
words of every text nor those of one.  A text's distinct lexicon terms are sorted and hashed, once as a whole and once for
each of several random subsets of the lexicon, and these hashes are its fingerprint.  A subset keeps a share of all terms,
from a half down to a few in a thousand, so that texts of any length have subsets from which only some terms remain: if
those terms are untouched by an edit, the hash is too.  Two fingerprints are as alike as the share of subsets with equal
hashes among those from which either text has a term.

Terms are told apart by a 64-bit hash; the lexicon is a bitmap over 2^24 groups of hashes, two megabytes whatever the size
of the corpus, and document frequencies are counted for these groups over all documents.

Cases: a null text is empty; a text without lexicon terms is hashed over all of its terms, a blank one over none; in the
descending order of ids, null ids come last and equal ids are ordered by text; the last row is followed by the first, a
single row by itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whylake.llm.common import bitmap_of, group_of, if_small, in_bitmap, materialise, table

#: Bounds of the inverse document frequency ln(N / df) of lexicon terms.
LEAST_IDF, MOST_IDF = 2.5, 7.0
#: Subsets of the lexicon for each share of its terms, and those shares as powers of two.
EACH, POWERS = 12, (1, 3, 5, 7, 9)
BLANK = "[\\x20\\x09-\\x0D]+"
#: Neighbouring ids that are ordered together, as a power of two.
RUN_BITS, LEVEL_BITS = 8, 12
#: Hash of no terms at all (32 bits).
NOTHING = 42


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's terms."""
    words = F.array_remove(F.split(F.lower(text), BLANK), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row with the bitmap of the terms in the band, as an array of 2^18 longs."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = docs.count()
    # outer, because a plain generator makes Spark compute the array a second time to look whether it is empty
    groups = rows.select(F.explode_outer(F.array_distinct(F.transform(term_hashes(F.col("text")), group_of))).alias("g"))
    counted = groups.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    kept = counted.where(F.col("df").between(n * math.exp(-MOST_IDF), n * math.exp(-LEAST_IDF)))
    return bitmap_of(kept.select("g"))


def subsets() -> Column:
    """Ranges of the hash space, a random one for each subset: a share of all hashes each."""
    import random

    draw, out = random.Random(4), []
    for power in POWERS:
        width = 1 << (64 - power)
        for _ in range(EACH):
            low = draw.randrange(-(1 << 63), (1 << 63) - width + 1)
            out.append(F.struct(F.lit(low).alias("low"), F.lit(low + width - 1).alias("high")))
    return F.array(*out)


def low_bits(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def with_signatures(rows: DataFrame, text: str, bitmap: Column, name: str) -> DataFrame:
    """Add the array of hashes of ``text``: of all lexicon terms, then of each subset."""
    rows = rows.withColumn("__all", term_hashes(F.col(text))).withColumn("__bitmap", bitmap)
    rows = rows.withColumn("__band", F.filter("__all", lambda h: in_bitmap("__bitmap", h))).drop("__bitmap")
    rows = rows.withColumn("__terms", F.array_sort(F.when(F.size("__band") > 0, F.col("__band")).otherwise(F.col("__all")))).drop("__all", "__band")
    parts = F.transform(subsets(), lambda s: low_bits(F.xxhash64(F.filter("__terms", lambda t: (t >= s.low) & (t <= s.high)))))
    return rows.withColumn(name, F.concat(F.array(low_bits(F.xxhash64("__terms"))), parts)).drop("__terms")


def as_text(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal lexicon terms, else the best of the shares: for the subsets of one size, those with equal hashes among
    those from which either text has a term.  Sizes that are too large for a text never match, and those too small are
    empty; a share of fewer than four subsets counts as one of four."""
    marks = F.zip_with(F.slice(a, 2, 1 << 20), F.slice(b, 2, 1 << 20), lambda x, y: F.when((x == NOTHING) & (y == NOTHING), 0).when(x == y, 2).otherwise(1))

    def share(power: Column) -> Column:
        own = F.slice(marks, power * EACH + 1, F.lit(EACH))
        return F.size(F.filter(own, lambda m: m == 2)) / F.greatest(F.size(F.filter(own, lambda m: m > 0)), F.lit(4))

    return F.when(a[0] == b[0], F.lit(1.0)).otherwise(F.array_max(F.transform(F.array(*map(F.lit, range(len(POWERS)))), share)))


def following(docs: DataFrame) -> DataFrame:
    """(run, text): for each run of neighbouring ids the text that follows its last row, from another run.

    ``docs``: (place, text) with the run as ``place >> RUN_BITS``.  Only ids are ordered, in groups at three levels; the
    level that meets in one task has one row for each 2^20 ids.
    """
    runs = materialise(docs.groupBy(F.shiftright("place", RUN_BITS).alias("run")).agg(F.max("place").alias("head")))
    level = F.shiftright("run", LEVEL_BITS)
    inside = runs.withColumn("level", level).withColumn("next", F.lead("head").over(Window.partitionBy("level").orderBy(F.desc("run"))))
    tops = inside.groupBy("level").agg(F.max("head").alias("top"))
    down = Window.orderBy(F.desc("level"))
    after = tops.select("level", F.coalesce(F.lead("top").over(down), F.first("top").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below"))
    linked = inside.join(after, "level").select("run", F.coalesce("next", "below").alias("head"))
    # ids alone, so even a million of them are small; beyond that the texts are shuffled to meet them
    firsts = if_small(runs.select(F.col("head").alias("place")), 1_000_000)
    heads = docs.join(firsts, "place", "left_semi").groupBy("place").agg(F.min("text").alias("text"))
    return linked.join(heads, linked["head"] == heads["place"]).select("run", "text")


def edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, signatures, edited, edited_signatures, next_signatures) of every row.

    The edited text has its last half replaced by the beginning of the next document, in descending order of ids.
    """
    bitmap = lexicon(docs, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).cast("long").alias("place"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    run = F.shiftright("place", RUN_BITS).alias("run")
    own = rows.select("doc_id", "place", "text", run, F.lit(1).alias("real"))
    extra = following(rows.select("place", "text")).select(F.lit(None).cast(own.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("place"), "text", "run", F.lit(0).alias("real"))
    signed = with_signatures(own.union(extra), "text", bitmap.scalar(), "signatures")
    order = Window.partitionBy("run").orderBy(F.desc("real"), F.desc("place"), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    paired = (
        signed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_signatures", F.lead("signatures").over(order))
        .where("real = 1")
        .select("doc_id", "text", "signatures", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"), "next_signatures")
    )
    return with_signatures(paired, "edited", bitmap.scalar(), "edited_signatures")


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("signatures")).alias("fingerprint"), as_text(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"))
