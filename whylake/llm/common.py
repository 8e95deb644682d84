"""What the operators of this package share: safe column names, whole tables, written intermediate results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whylake.session import cut_lineage

#: A word: a run of anything but these six characters.
WHITE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not hold yet, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def materialise(df: DataFrame) -> DataFrame:
    """Keep an expensive intermediate result in the shared checkpoint folder, so that it is computed once."""
    return cut_lineage(df)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    written = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(written, F.lit("")).cast("binary")) % modulus


#: Different labels that a model may learn, the most frequent ones where there are more.
MOST_LABELS = 256


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, most_chars: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(label, text) of at most ``per_label`` documents of each label in ``labels`` (doc_id, label), none over ``most_chars``.

    Only documents that can be learned from are ranked, so a label is filled up to its bound while it has such documents.
    They are chosen by a hash of their id, and of repeated ids the text with the smallest hash, so a repeated run takes the
    same ones.  Ids and lengths are joined; only the chosen ids, whose number is bounded, are broadcast to fetch texts.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    usable = read.where(F.length("text") <= most_chars).groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    known = labels.where("doc_id is not null and label is not null").distinct().join(usable, "doc_id")
    known = materialise(known.withColumn("draw", F.xxhash64("doc_id")))
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()
    # of a label with more documents, only the lowest hashes are candidates: no task sorts a whole label
    limit = F.lit(None).cast("long")
    for c in counts:
        most = -(1 << 63) + int((1 << 64) * 1.5 * per_label / c.n) if c.n > 2 * per_label else (1 << 63) - 1
        limit = F.when(F.col("label") == c.label, F.lit(most)).otherwise(limit)
    order = Window.partitionBy("label").orderBy("draw", "doc_id")
    ranked = known.where(F.col("draw") <= limit).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label)
    chosen = ranked.select("doc_id", "text_hash", "label")
    rows = chosen.collect()  # bounded: per_label ids of each label
    wanted = docs.sparkSession.createDataFrame(rows, chosen.schema)
    return read.join(F.broadcast(wanted), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "label"]).select("label", "text")


#: Hashes are told apart in bitmaps by this many of their bits: two megabytes, whatever the corpus holds.
GROUP_BITS = 24


def group_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - GROUP_BITS)


def bitmap_of(groups: DataFrame) -> DataFrame:
    """One row with the bitmap of the groups ``g``, as an array of 2^18 longs."""
    bits = groups.groupBy(F.shiftright("g", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(g & 63 as int))")).alias("bits"))
    everything = groups.sparkSession.range(1 << (GROUP_BITS - 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = bits.union(everything).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = whole.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return materialise(row.select(F.col("words.bits").alias("bitmap")))


def in_bitmap(bitmap: str, h: Column) -> Column:
    g = group_of(h)
    word = F.element_at(bitmap, (F.shiftright(g, 6) + 1).cast("int"))
    return F.call_function("shiftright", word, g.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


#: Rows up to which the smaller side of a join is sent to all executors.
SMALL = 20_000


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A hint to broadcast ``df``, a written table, if a count shows that it is small; Spark decides otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
