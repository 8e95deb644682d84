"""Personal data by bootstrapped contextual extraction.

Four kinds have fixed forms: e-mail and IP addresses, card and phone numbers; long runs of hexadecimal digits are a fifth
kind of seed.  The two words before a seed are a lexical pattern.  A pattern that precedes enough different seeds is
followed through the whole corpus: all words after it are its instances, and if too few of them are seeds it is dropped.
What is left is a graph of patterns and instances.  In each round a pattern is as sure as the mean of its instances, and an
instance that is no seed as sure as any of its patterns makes it.  Sure patterns discover identifiers that have no fixed
form: the words after them that hold a digit or an at sign.

A pattern is known by a 64-bit hash of its words.  Which hashes to look for is a bitmap of two megabytes whatever the size
of the corpus; what it lets through by chance is dropped by an exact join.

Cases: a null text is empty and holds nothing; a null id is kept; rows with equal id and text have equal results; a span
lies in one text, counted in code points from 0, its end exclusive; spans of different kinds may overlap; an empty table
gives no rows; extra columns are ignored, and kept by ``masked``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whylake.llm.common import bitmap_of, fresh, group_of, in_bitmap, materialise, table

#: Different seeds that a pattern must precede, in a corpus of any size, and the least share of seeds among all words after
#: it.  The share bounds the work: no more words are fetched than 1 / ``LEAST_SHARE`` for each seed.
SUPPORT, LEAST_SHARE = 3, 0.05
ROUNDS, SURE = 3, 0.5
#: Bounds of the parts, in shares of the last, in which words after patterns are counted.
PARTS = (0, 1, 8, 64)
#: Numbers that are added up one after the other in ``running``; sums of such stretches are put together after that.
STRETCH = 64

# The forms of the base kinds.  Groups are possessive where nothing that follows could need less of them.
LOCAL = "[A-Za-z0-9._%+-]"
FORMS = {
    "email": (f"{LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", f"(?<!{LOCAL})"),
    "ip": ("[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "(?<![0-9])"),
    "card": ("[0-9](?:[\\x20-]?[0-9])++", ""),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", ""),
    "secret": ("[0-9a-fA-F]{32,}+", "(?<![0-9A-Za-z])"),
}
BASE = ["email", "ip", "card", "phone"]
KINDS = [*FORMS, "id"]
#: What a text must hold to have any match of a kind.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "secret": "[0-9a-fA-F]{32}"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BLANK = "[\\x20\\x09-\\x0D]"
SOLID = "[^\\x20\\x09-\\x0D]"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of a card number pass the check: from the right, every second one doubled."""
    places = F.split(F.reverse(number), "")
    weighed = F.transform(places, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    if kind == "card":
        n = F.length(digits(value))
        return F.when(n.between(13, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[a-fA-F]")
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, stretch: int = STRETCH) -> Column:
    """Running sums of an array.  An array grows by copying, so sums are made in stretches and those put together."""
    def grown(values: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + of(x))))

    def joined_up(local: Column) -> Column:
        offsets = grown(local, lambda part: F.element_at(part, -1))
        return let(offsets, lambda begin: F.flatten(F.transform(local, lambda part, i: F.transform(F.slice(part, F.lit(2), F.size(part)), lambda x: x + F.get(begin, i)))))

    def parts(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / stretch).cast("int")), lambda c: grown(F.slice(n, c * stretch + 1, F.lit(stretch)), lambda x: x))

    return let(numbers, lambda n: F.when(F.size(n) > 0, let(parts(n), joined_up)).otherwise(F.array().cast("array<int>")))


def spans_of(kind: str, text: Column) -> Column:
    """Array of (kind, start, stop, value, word) of the valid matches, leftmost first and not overlapping.

    Each match is taken together with the gap before it, from where the last one ended, so lengths add up to positions, and
    blanks add up to ``word``, the place of the word in which a match begins.
    """
    form, edge = FORMS[kind]
    gap = f"(|(?s:.*?){edge})" if edge else "((?s:.*?))"
    pattern = f"\\G{gap}({form})"
    whole = F.when(text.rlike(NEEDS[kind]), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def placed(pieces: Column) -> Column:
        stops, words = running(F.transform(pieces, F.length)), running(F.transform(pieces, blanks))

        def span(piece: Column, i: Column, place: Column) -> Column:
            value = F.regexp_extract(piece, pattern, 2)
            stop = F.get(place["stops"], i)
            return let(value, lambda v: F.struct(F.lit(kind).alias("kind"), (stop - F.length(v)).alias("start"), stop.alias("stop"), v.alias("value"), (F.get(place["words"], i) - blanks(v)).alias("word")))

        return let(F.struct(stops.alias("stops"), words.alias("words")), lambda place: F.transform(pieces, lambda piece, i: span(piece, i, place)))

    return F.filter(let(whole, placed), lambda s: valid(kind, s["value"]))


def blanks(value: Column) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, BLANK, ""))


def bare(word: Column) -> Column:
    """A word without the punctuation around it."""
    return F.regexp_replace(word, "^[^\\p{L}\\p{N}+]+|[^\\p{L}\\p{N}]+$", "")


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    clean = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(clean).alias("text_hash"), clean.alias("text"))


def seeded(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): seeds of every text with the hashes of their pattern and value; texts are left out.

    The pattern is the hash of the two words before the word in which a seed begins; null where there are fewer.
    """
    for kind in FORMS:
        rows = rows.withColumn(f"in_{kind}", spans_of(kind, F.col("text")))
    every = F.concat(*(F.col(f"in_{k}") for k in FORMS))

    def marked(spans: Column, words: Column) -> Column:
        before = lambda s: F.xxhash64(F.get(words, s["word"] - 2), F.get(words, s["word"] - 1))
        return F.transform(spans, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
            F.when(s["word"] >= 2, before(s)).alias("pattern"), F.xxhash64(F.lower(s["value"])).alias("instance")))

    lower_words = F.when(F.size(every) > 0, F.split(F.lower("text"), BLANK))
    return rows.select("doc_id", "text_hash", let(lower_words, lambda w: marked(every, w)).alias("spans"))


def hits_in(rows: DataFrame, bitmap: Column) -> DataFrame:
    """``rows`` with ``hits``: (pattern, place) of every word whose two words before are a pattern of the bitmap."""
    rows = rows.withColumn("lower_words", F.split(F.lower("text"), BLANK)).withColumn("bitmap", bitmap)
    n = F.greatest(F.size("lower_words") - 2, F.lit(0))
    hashes = F.transform(F.zip_with(F.slice("lower_words", F.lit(1), n), F.slice("lower_words", F.lit(2), n), lambda a, b: F.xxhash64(a, b)),
                         lambda h, i: F.struct(h.alias("pattern"), (i + 2).alias("place")))
    return rows.withColumn("hits", F.filter(hashes, lambda h: in_bitmap("bitmap", h["pattern"])))


def counted(sorted_values: Column) -> Column:
    """(pattern, n) for each run of equal values of a sorted array."""
    def of(v: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(v)), lambda i: (i == F.size(v)) | (F.get(v, i) != F.get(v, i - 1)))
        return let(ends, lambda e: F.transform(e, lambda end, i: F.struct(F.get(v, end - 1).alias("pattern"), (end - F.when(i > 0, F.get(e, i - 1)).otherwise(0)).cast("long").alias("n"))))

    return let(sorted_values, lambda v: F.when(F.size(v) > 0, of(v)))


def context_counts(rows: DataFrame, bitmap: Column) -> DataFrame:
    """(pattern, n): how many words of the corpus follow each pattern of the bitmap, a row for each text and pattern."""
    found = hits_in(rows, bitmap).select(counted(F.sort_array(F.transform("hits", lambda h: h["pattern"]))).alias("counts"))
    # outer, because a plain generator makes Spark compute the array a second time to look whether it is empty
    return found.select(F.explode_outer("counts").alias("c")).where("c is not null").select("c.pattern", "c.n")


def contexts(rows: DataFrame, bitmap: Column) -> DataFrame:
    """A row for each word of the corpus whose two words before are a pattern of the bitmap, with where it starts."""
    found = hits_in(rows, bitmap)
    words = F.when(F.size("hits") > 0, F.split("text", BLANK))

    def placed(words: Column) -> Column:
        stops = running(F.transform(words, lambda w: F.length(w) + 1))
        return let(stops, lambda s: F.transform("hits", lambda h: F.struct(
            h["pattern"].alias("pattern"), F.get(words, h["place"]).alias("word"), F.get(s, h["place"] - 1).alias("start"))))

    found = found.select("doc_id", "text_hash", let(words, lambda w: F.when(w.isNotNull(), placed(w))).alias("hits"))
    return found.select("doc_id", "text_hash", F.explode_outer("hits").alias("hit")).where("hit is not null").select("doc_id", "text_hash", "hit.*")


def discovered(rows: DataFrame, seeds: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """(doc_id, text_hash, start, stop) of identifiers that sure patterns lead to."""
    found = materialise(seeds.select(F.inline("spans")).where("pattern is not null").select("pattern", "instance").distinct())
    supported = materialise(found.groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= support))
    occurring = seeds.select(F.inline("spans")).groupBy("pattern").agg(F.count(F.lit(1)).alias("as_seed"))
    open_ = materialise(supported.join(occurring, "pattern").select("pattern", "as_seed", F.lit(0).cast("long").alias("n")))
    # words after each pattern, counted and not fetched: those that ordinary text follows too often are no patterns of identifiers.
    # All texts are counted, in parts that grow, and a pattern that has too many words already is counted no further
    for low, high in zip(PARTS, PARTS[1:], strict=False):
        part = rows.where(F.pmod("text_hash", F.lit(PARTS[-1])).between(low, high - 1))
        bitmap = bitmap_of(open_.select(group_of(F.col("pattern")).alias("g")))
        more = context_counts(part, bitmap.scalar()).groupBy("pattern").agg(F.sum("n").alias("more"))
        total = F.col("n") + F.coalesce("more", F.lit(0))
        open_ = materialise(open_.join(more, "pattern", "left").where(F.col("as_seed") >= LEAST_SHARE * total).select("pattern", "as_seed", total.alias("n")))
    good = open_.select("pattern")
    bitmap = bitmap_of(good.select(group_of(F.col("pattern")).alias("g")))
    words = contexts(rows, bitmap.scalar()).join(good, "pattern", "left_semi").withColumn("value", bare(F.col("word")))
    words = materialise(words.select("doc_id", "text_hash", "pattern", "word", "value", "start", F.xxhash64(F.lower("value")).alias("instance")))

    known = found.select("instance", F.lit(1.0).alias("seed")).distinct()
    edges = words.select("pattern", "instance").distinct().join(known, "instance", "left")
    edges = materialise(edges.select("pattern", "instance", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("seed", F.lit(0.0)).alias("score")))
    for _ in range(rounds):
        patterns = edges.groupBy("pattern").agg((F.sum("score") / F.count(F.lit(1))).alias("sureness"))
        scored = edges.join(patterns, "pattern")
        # at least one of its patterns is right; a seed is sure by itself
        instances = scored.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("sureness"), F.lit(1e-9)))))).alias("by_patterns"))
        edges = materialise(edges.join(instances, "instance").select("pattern", "instance", "seed", F.greatest("seed", "by_patterns").alias("score")))
    strong = edges.groupBy("pattern").agg((F.sum("score") / F.count(F.lit(1))).alias("sureness")).where(F.col("sureness") >= sure)
    hits = words.where((F.length("value") >= 4) & F.col("value").rlike("[0-9@]")).join(strong, "pattern", "left_semi")
    start = F.col("start") + F.instr("word", F.col("value")) - 1
    return hits.select("doc_id", "text_hash", start.alias("start"), (start + F.length("value")).alias("stop"))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, spans): all spans of every text as (place of the kind, kind, start, stop), sorted."""
    rows = keyed(docs, text, doc_id)
    seeds = materialise(seeded(rows))
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    fixed = F.transform("spans", lambda s: F.struct(order[s["kind"]].alias("kind_no"), s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    more = discovered(rows, seeds).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(
        F.lit(KINDS.index("id")).alias("kind_no"), F.lit("id").alias("kind"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))).alias("more"))
    more = more.select(F.col("doc_id").alias("m_doc"), F.col("text_hash").alias("m_hash"), "more")
    both = seeds.select("doc_id", "text_hash", fixed.alias("fixed")).join(
        more, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("text_hash") == F.col("m_hash")), "left")
    # what a fixed form has found is not found again
    new = F.filter(F.coalesce("more", F.array().cast(both.schema["fixed"].dataType)), lambda m: ~F.exists("fixed", lambda s: (s["start"] < m["stop"]) & (m["start"] < s["stop"])))
    return both.select("doc_id", "text_hash", F.array_sort(F.concat("fixed", new)).alias("spans"))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def masked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; a null text stays null."""
    found = find(docs, text, doc_id).where(F.size("spans") > 0).distinct()
    found = found.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.array_sort(F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))).alias("__spans"))
    own = docs.alias("d")
    body = F.col(f"d.{text}")
    both = own.join(found.alias("f"), F.col(f"d.{doc_id}").eqNullSafe(F.col("f.__doc")) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("f.__hash")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))

    def cover(state: Column, s: Column) -> Column:
        """Add the text up to a span and its mark; a span that begins inside the last one only lengthens it."""
        apart = s["start"] >= state["done"]
        piece = F.concat(state["out"], F.substring(body, state["done"] + 1, s["start"] - state["done"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(apart, piece).otherwise(state["out"]).alias("out"), F.greatest(state["done"], s["stop"]).alias("done"))

    rest = F.aggregate(F.col("f.__spans"), start, cover, lambda st: F.concat(st["out"], F.substring(body, st["done"] + 1, F.length(body))))
    clean = F.when(F.col("f.__spans").isNull(), body).otherwise(rest)
    return both.select(*(clean.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns))


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    counts = [F.size(of_kind("spans", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
