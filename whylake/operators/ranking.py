"""Ordered selections that stay bounded when one group holds most of the rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from whylake.session import cut_lineage


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank.

    Filtering row_number directly lets Spark plan a WindowGroupLimit below the shuffle: every map task sends at most
    ``n`` rows per group, so a hot group never reaches one task whole.  That rule covers n up to 1000, so larger
    limits go through a salted first round that is bounded the same way.
    """
    if n <= 1000:
        window = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    reduced = salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_r", "_salt")
    window = W.partitionBy(*keys).orderBy(*order)
    return reduced.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def positions(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "position") -> DataFrame:
    """A dense 1-based position per group, computed without putting a whole group into one task.

    ``bucket`` must be monotone in ``order`` (for example the day of a timestamp).  Rows are counted per bucket, the
    small table of counts is summed up, and each row is numbered inside its bucket only.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(offsets, keys + ["_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_bucket", "_row", "_offset")
    )


def first_by(value: Column, order: Column, where: Column | None = None) -> Column:
    """Aggregate: the value at the smallest ``order`` among the rows that satisfy ``where``."""
    return F.min_by(value, order if where is None else F.when(where, order))


def first_texts(df: DataFrame, keys: list[str], text: Column, order: Column, n: int, name: str) -> DataFrame:
    """The first ``n`` distinct texts per group as an array, in order of first occurrence."""
    seen = df.select(*keys, text.alias("_text"), order.alias("_order")).groupBy(*keys, "_text").agg(
        F.min("_order").alias("_order")
    )
    top = top_n(seen, keys, [F.col("_order"), F.col("_text")], n, "_rank")
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_text"))), lambda x: x["_text"]).alias(name)
    )


def previous(df: DataFrame, keys: list[str], bucket: Column, order: str, value: str | None, name: str) -> DataFrame:
    """The ``value`` of the row before, in ``order``, within each group, without sorting a whole group in one task.

    Rows look back inside their bucket (monotone in ``order``); the first row of a bucket takes the last row of the
    bucket before it, found in the small table of bucket ends.  Adds ``name`` and ``name_order``; without a
    ``value`` only the latter, and nothing else moves.
    """
    rows = df.withColumn("_bucket", bucket)
    inside = W.partitionBy(*keys, "_bucket").orderBy(order)
    if value is None:
        ends = rows.groupBy(*keys, "_bucket").agg(F.max(order).alias("_end"))
        ends = ends.withColumn("_last", F.lag("_end").over(W.partitionBy(*keys).orderBy("_bucket"))).drop("_end")
        looked = rows.withColumn("_prev", F.lag(order).over(inside)).join(ends, keys + ["_bucket"])
        return looked.withColumn(name + "_order", F.coalesce("_prev", "_last")).drop("_bucket", "_prev", "_last")
    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(value, order), F.col(order)).alias("_end"))
    ends = ends.withColumn("_last", F.lag("_end").over(W.partitionBy(*keys).orderBy("_bucket"))).drop("_end")
    looked = rows.withColumn("_prev", F.lag(F.struct(value, order)).over(inside)).join(ends, keys + ["_bucket"])
    found = F.coalesce("_prev", "_last")
    return looked.withColumns({name: found[value], name + "_order": found[order]}).drop("_bucket", "_prev", "_last")


#: A sieve has from 2^12 bits, for few keys, to 2^24, which are two megabytes however many keys there are.
SIEVE_BITS = (12, 24)


class Sieve:
    """A bitmap of the hashed keys of ``wanted``, made at once; only its words come to the driver."""

    def __init__(self, wanted: DataFrame, keys: list[str]):
        least, most = SIEVE_BITS
        group = F.shiftrightunsigned(F.xxhash64(*keys), 64 - most)
        words = wanted.select(group.alias("g")).groupBy(F.shiftright("g", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(g & 63 as int))")).alias("bits")).toArrow()
        set_bits = np.unpackbits(words["bits"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(set_bits)
        groups = words["word"].to_numpy()[row] * 64 + bit
        self.keys, self.width = keys, int(np.clip(math.ceil(math.log2(16 * len(groups) + 1)), least, most))  # 16 bits for a key, if they are few
        dense = np.zeros(1 << self.width, np.uint8)
        dense[groups >> (most - self.width)] = 1
        array = pa.ListArray.from_arrays([0, 1 << (self.width - 6)], np.packbits(dense, bitorder="little").view("<i8"))
        self.table = wanted.sparkSession.createDataFrame(pa.table({"bits": array}))

    def holds(self) -> Column:
        """Whether a row's keys may be among those wanted; a false answer is sure."""
        group = F.shiftrightunsigned(F.xxhash64(*self.keys), 64 - self.width)
        word = F.get(self.table.scalar(), F.shiftright(group, 6).cast("int"))
        return F.call_function("shiftright", word, group.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def sieved(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose keys are among those of ``wanted``, and a few others by chance; a join has to follow.

    ``wanted`` should be cheap to read.  Rows are looked up where they are, so that few are shuffled for the join, whatever side
    Spark finds small, and however late it does.
    """
    return df.filter(Sieve(wanted, keys).holds())


def among(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose keys are among those of ``wanted``, a written table."""
    return sieved(df, keys, wanted).join(wanted.select(*keys).distinct(), keys, "left_semi")


def left_few(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` left joined with ``few``.  Rows that surely have no partner are not shuffled; ``df`` is read twice."""
    may = Sieve(few, keys)
    return df.filter(may.holds()).join(few, keys, "left").unionByName(df.filter(~may.holds()), allowMissingColumns=True)


def without_few(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` without a partner in ``few``, joined where they may have one."""
    may = Sieve(few, keys)
    return df.filter(may.holds()).join(few.select(*keys), keys, "left_anti").unionByName(df.filter(~may.holds()))


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """A dense number from 0 in the order of all rows: a range sort, and offsets from the counts of its partitions."""
    rows = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}))
    parts = rows.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part")) - F.col("_n")  # a row for each partition
    return rows.join(F.broadcast(parts.withColumn("_before", before)), "_part").withColumn(
        name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_n", "_before")
