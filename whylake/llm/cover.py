"""Repeated passages across documents, found by anchors at the positions of a difference cover.

Every run of ``WINDOW`` words whose words also start earlier (in a document with a smaller id, or further up in the same one)
is removed.  Only positions p with p modulo ``PERIOD`` in ``COVER`` are hashed, as anchors of ``WINDOW - PERIOD + 1`` words.
Every difference modulo the period is a difference of two members of the cover, so two equal windows have, at some common
offset below the period, an anchor at a cover position in both.  Anchors that occur once are dropped.  Around the
others windows are extended to their full length, hashed anew (96 bits) and compared: the earliest of equal windows stays.

Only the first document of each text takes part; all windows of its copies have an earlier one.  Hashes travel packed: a
task gathers those of many texts, settles what repeats among them, and sends each hash once, packed with the others of
its bucket, so a passage in a third of all documents costs a few bytes for each task and no group of its occurrences is
ever gathered.  Buckets are as many as ``spark.sql.shuffle.partitions``.  Texts travel compressed.

Cases: a null or empty text has no words; a text shorter than a window loses nothing; a null id comes before all others; of
rows with equal ids, the hash of the text decides which is earlier; equal rows are copies, and one of them is the
earlier; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whylake.llm.common import materialise, table
from whylake.llm.words import Remembered, WordTable, slices

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
#: Hashes that a task gathers before it sends them.
GATHERED = 1_000_000
#: Bytes of a hash that are sent: of an anchor, which only selects, and the two parts of a window's.
ANCHOR_BYTES, HIGH_BYTES, LOW_BYTES = 6, 8, 2

EMPTY = hashlib.sha256(b"").hexdigest()


def check_cover(window: int, period: int, cover: tuple[int, ...]) -> None:
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("some difference modulo the period is not covered")
    if not 0 < period <= window:
        raise ValueError("the period must not be longer than a window")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no trace of sums."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hash(h: np.ndarray, at: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * np.uint64(factor) + h[at + k]
    return mixed(out)


def word_hashes(words: list[str]) -> list[int]:
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words]


class Texts:
    """The words of a part of a batch as hashes, with where each document begins and ends."""

    def __init__(self, texts: pa.Array, known: Remembered):
        table = WordTable(texts)
        self.hash = np.array(known(table.words), np.uint64)[table.place] if len(table.place) else np.zeros(0, np.uint64)
        self.doc = table.doc
        self.size = np.bincount(table.doc, minlength=table.docs)
        self.begin = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.doc)) - self.begin[self.doc]

    def anchors(self, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors begin, and their hashes."""
        size = window - period + 1
        chosen = np.zeros(period, bool)
        chosen[list(cover)] = True
        n = self.size[self.doc]
        at = np.flatnonzero(chosen[self.place % period] & (self.place + size <= n) & (n >= window))
        return at, run_hash(self.hash, at, size, 0x9E3779B97F4A7C15)

    def around(self, anchors: np.ndarray, window: int, period: int) -> np.ndarray:
        """Where the windows begin that hold one of the anchors."""
        doc = self.doc[anchors]
        low = np.maximum(anchors - period + 1, self.begin[doc])
        high = np.minimum(anchors, self.begin[doc] + self.size[doc] - window) + 1
        real = low < high
        change = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(change, low[real], 1)
        np.add.at(change, high[real], -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def cut(h: np.ndarray, size: int) -> np.ndarray:
    """The upper ``size`` bytes of 64-bit hashes, as numbers."""
    return h >> np.uint64(64 - 8 * size)


def to_bytes(values: np.ndarray, size: int) -> bytes:
    """Numbers that fit in ``size`` bytes, written with so many."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def from_bytes(rows: pa.Array, size: int) -> np.ndarray:
    """The numbers of all rows, one after the other."""
    raw = np.frombuffer(b"".join(rows.to_pylist()), np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view("<u8").reshape(-1)


def least(values: np.ndarray) -> type:
    """The smaller of two widths that holds the numbers."""
    return np.uint16 if values.max(initial=0) < 1 << 16 else np.uint32


def packed(bucket: np.ndarray, owner: np.ndarray, *values: tuple[np.ndarray, int]) -> Iterator[tuple]:
    """(bucket, entries, owners, whose, values) for each bucket: distinct owners, and for each entry the place of its own.

    Values come with their bytes; 0 means two or four, as the row needs.
    """
    order = np.lexsort((owner, bucket))
    bucket, owner, values = bucket[order], owner[order], [(v[order], size) for v, size in values]
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if lo < hi:
            owners, whose = np.unique(owner[lo:hi], return_inverse=True)
            rest = (to_bytes(v[lo:hi], size) if size else v[lo:hi].astype(least(v[lo:hi])).tobytes() for v, size in values)
            yield int(bucket[lo]), hi - lo, owners.astype("<i8").tobytes(), whose.astype(least(whose)).tobytes(), *rest


def narrow(rows: pa.Array, sizes: list[int]) -> np.ndarray:
    """The numbers of all rows of two or four bytes; ``sizes`` tells how many each holds."""
    out = [np.frombuffer(r, np.uint16 if len(r) == 2 * n else np.uint32).astype(np.int64) for r, n in zip(rows.to_pylist(), sizes, strict=True)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def owners_of(owners: pa.Array, whose: pa.Array, sizes: list[int]) -> np.ndarray:
    """The owners of all entries of the rows, one after the other."""
    listed = [np.frombuffer(o, "<i8") for o in owners.to_pylist()]
    shift = np.repeat(np.cumsum([0, *map(len, listed)])[:-1], sizes)
    return np.concatenate(listed)[narrow(whose, sizes) + shift] if listed else np.zeros(0, np.int64)


class Group:
    """The rows sent to one bucket."""

    def __init__(self, group: pa.Table):
        self.column = {n: pa.concat_arrays(group.column(n).chunks) if group.num_rows else group.column(n) for n in group.column_names}
        known = np.array(self.column["known"].to_pylist(), bool)
        marked = np.array([v is None for v in self.column["owners"].to_pylist()], bool)
        self.ready, self.open, self.marks = (pa.array(np.flatnonzero(x)) for x in (known, ~known & ~marked, marked))

    def take(self, name: str, rows: pa.Array) -> pa.Array:
        return self.column[name].take(rows)

    def sizes(self, rows: pa.Array) -> list[int]:
        return self.take("n", rows).to_pylist()

    def sent_back(self, name: str, found: Iterator[tuple]) -> pa.Table:
        """Packed rows on their way to owners: those that came settled, and what was found here."""
        ready = zip(*(self.take(c, self.ready).to_pylist() for c in ("bucket", "n", "owners", "whose", name)), strict=True)
        return pa.Table.from_batches([batch_of([*ready, *found], BACK)])

    def owners(self, rows: pa.Array) -> np.ndarray:
        return owners_of(self.take("owners", rows), self.take("whose", rows), self.sizes(rows))


def by_owner(owner: np.ndarray, values: np.ndarray, size: int) -> list[tuple[int, bytes]]:
    """Each owner with its values, ``size`` bytes each."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
    return [(int(owner[lo]), to_bytes(values[lo:hi], size)) for lo, hi in zip(edges, edges[1:], strict=False) if lo < hi]


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: where each run of equal ones begins, and the run of every row."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


# columns of what is sent to a bucket; a row without owners holds hashes that are known to repeat
ANCHORS = "bucket int, known boolean, n int, owners binary, whose binary, hashes binary"
BACK = "bucket int, n int, owners binary, whose binary, found binary"
WINDOWS = "bucket int, known boolean, n int, owners binary, whose binary, starts binary, hashes binary, lows binary"


def gathered(batches: Iterator[pa.RecordBatch], found: Callable[[pa.RecordBatch], tuple], send: Callable[..., pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``found`` has of each part of the batches, sent together once it is enough."""
    held, count = [], 0
    for batch in batches:
        for part in slices(batch, 1):
            held.append(found(part))
            count += len(held[-1][0])
            if count >= GATHERED:
                yield send(*map(np.concatenate, zip(*held, strict=True)))
                held, count = [], 0
    if count:
        yield send(*map(np.concatenate, zip(*held, strict=True)))


def send_anchors(docs: DataFrame, buckets: int, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """Packed anchors of (c1, text): those that repeat within a task's texts are known already."""
    def send(h: np.ndarray, owner: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
        """Of copies, which have one owner, an anchor counts once; ``twice`` tells that it repeats within its text."""
        order = np.lexsort((~twice, owner, h))
        h, owner, twice = h[order], owner[order], twice[order]
        one, _ = runs(h, owner)
        h, owner, twice = h[one], owner[one], twice[one]
        first, run = runs(h)
        often = (np.diff([*first, len(h)]) > 1) | np.logical_or.reduceat(twice, first)
        repeats, marks = often[run], h[first[often]]
        to = lambda v: v.view(np.uint64) % np.uint64(buckets)
        rows = [(b, False, *rest) for b, *rest in packed(to(h[~repeats]), owner[~repeats], (cut(h[~repeats], ANCHOR_BYTES), ANCHOR_BYTES))]
        rows += [(b, False, n, None, None, x) for b, n, _, _, x in packed(to(marks), np.zeros(len(marks), np.int64), (cut(marks, ANCHOR_BYTES), ANCHOR_BYTES))]
        # whom those belong to is told by way of any bucket
        rows += [(b, True, *rest) for b, *rest in packed(to(owner[repeats]), owner[repeats], (cut(h[repeats], ANCHOR_BYTES), ANCHOR_BYTES))]
        return batch_of(rows, ANCHORS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(word_hashes)

        def found(part: pa.RecordBatch) -> tuple:
            texts = Texts(part.column(1), known)
            at, h = texts.anchors(window, period, cover)
            order = np.lexsort((h, texts.doc[at]))
            doc, h = texts.doc[at][order], h[order]
            first, _ = runs(doc, h)
            return h[first], part.column(0).to_numpy()[doc[first]], np.diff([*first, len(h)]) > 1

        return gathered(batches, found, send)

    return docs.select("c1", "text").mapInArrow(of, ANCHORS)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def repeated_anchors(sent: DataFrame, buckets: int) -> DataFrame:
    """(c1, hashes): the anchors of each text that occur more than once."""
    def of(group: pa.Table) -> pa.Table:
        rows = Group(group)
        anchors = lambda which: from_bytes(rows.take("hashes", which), ANCHOR_BYTES)
        h, owner = anchors(rows.open), rows.owners(rows.open)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        one, _ = runs(h, owner)
        h, owner = h[one], owner[one]
        first, run = runs(h)
        hit = (np.diff([*first, len(h)]) > 1)[run] | np.isin(h, anchors(rows.marks))
        return rows.sent_back("hashes", packed(owner[hit].view(np.uint64) % np.uint64(buckets), owner[hit], (h[hit], ANCHOR_BYTES)))

    return delivered(sent.groupBy("bucket").applyInArrow(of, BACK), "c1", "hashes", ANCHOR_BYTES)


def earliest(h: np.ndarray, low: np.ndarray, owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted windows, where the runs of equal ones begin, and which of them have an earlier one."""
    order = np.lexsort((start, owner, low, h))
    h, low, owner, start = h[order], low[order], owner[order], start[order]
    first, run = runs(h, low)
    later = (owner != owner[first][run]) | (start != start[first][run]) if len(h) else np.zeros(0, bool)
    return h, low, owner, start, first, later


def delivered(back: DataFrame, owner: str, name: str, size: int) -> DataFrame:
    """(owner, values): what was sent back to each owner, gathered in the bucket of the owners."""
    schema = f"{owner} long, {name} binary"

    def of(group: pa.Table) -> pa.Table:
        column = {n: pa.concat_arrays(group.column(n).chunks) for n in group.column_names}
        sizes = column["n"].to_pylist()
        values = from_bytes(column["found"], size) if size else narrow(column["found"], sizes)
        return pa.Table.from_batches([batch_of(by_owner(owners_of(column["owners"], column["whose"], sizes), values, size or 4), schema)])

    return back.groupBy("bucket").applyInArrow(of, schema)


def send_windows(docs: DataFrame, buckets: int, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """Packed windows around the repeated anchors of (ord, z, hashes): the first of equal ones among a task's texts.

    The others are known to have an earlier one; a row says so that is on its way to the document.
    """
    def send(h: np.ndarray, low: np.ndarray, owner: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        h, low, owner, start, first, later = earliest(h, low, owner, start)
        to = lambda v: v.view(np.uint64) % np.uint64(buckets)
        rows = [(b, True, *rest, None, None) for b, *rest in packed(to(owner[later]), owner[later], (start[later], 0))]
        rows += [(b, False, *rest) for b, *rest in packed(to(h[first]), owner[first], (start[first], 0), (h[first], HIGH_BYTES), (low[first], LOW_BYTES))]
        return batch_of(rows, WINDOWS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(word_hashes)

        def found(part: pa.RecordBatch) -> tuple:
            texts = Texts(pa.array(unzipped(part.column(1)), pa.string()), known)
            at, h = texts.anchors(window, period, cover)
            # an anchor that repeats for one text does so for all
            repeated = np.unique(from_bytes(part.column(2), ANCHOR_BYTES))
            at = texts.around(at[np.isin(cut(h, ANCHOR_BYTES), repeated)], window, period)
            low = cut(run_hash(mixed(texts.hash), at, window, 0xD6E8FEB86659FD93), LOW_BYTES)
            return run_hash(texts.hash, at, window, 0x9E3779B97F4A7C15), low, part.column(0).to_numpy()[texts.doc[at]], texts.place[at]

        return gathered(batches, found, send)

    return docs.select("ord", "z", "hashes").mapInArrow(of, WINDOWS)


def later_windows(sent: DataFrame, buckets: int) -> DataFrame:
    """(ord, starts): the windows of each document that have an earlier equal one."""
    def of(group: pa.Table) -> pa.Table:
        rows = Group(group)
        starts = lambda which: narrow(rows.take("starts", which), rows.sizes(which))
        h, low = from_bytes(rows.take("hashes", rows.open), HIGH_BYTES), from_bytes(rows.take("lows", rows.open), LOW_BYTES)
        _, _, owner, start, _, later = earliest(h, low, rows.owners(rows.open), starts(rows.open))
        return rows.sent_back("starts", packed(owner[later].view(np.uint64) % np.uint64(buckets), owner[later], (start[later], 0)))

    return delivered(sent.groupBy("bucket").applyInArrow(of, BACK), "ord", "starts", 0)


def zipped(docs: DataFrame) -> DataFrame:
    """(doc_id, c1, c2, z): texts compressed, for the way to another task."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        press = ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, 3):
                z = pa.array([press.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in part.column(3)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), z], names=["doc_id", "c1", "c2", "z"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "c1", "c2", "text").mapInArrow(of, f"doc_id {kind}, c1 long, c2 long, z binary")


def unzipped(texts: pa.Array) -> list[str]:
    from zstandard import ZstdDecompressor

    press = ZstdDecompressor()
    return [press.decompress(z.as_py()).decode("utf-8", "surrogatepass") for z in texts]


def kept_words(text: str | None, starts: bytes, window: int) -> tuple[int, int, str]:
    """Words, removed words, and what is left of a text without its windows at ``starts``."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    at = np.frombuffer(starts, "<u4").astype(np.int64)
    change = np.zeros(len(words) + window, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    kept = [words[i] for i in np.flatnonzero(np.cumsum(change)[: len(words)] == 0).tolist()] if len(at) else words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def cut_texts(docs: DataFrame, window: int, z: bool) -> DataFrame:
    """(doc_id, c1, c2, n_words, n_removed, kept_sha256) of (doc_id, c1, c2, z, starts), or of whole texts."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                texts = unzipped(part.column(3)) if z else part.column(3).to_pylist()
                rows = [kept_words(t, s, window) for t, s in zip(texts, part.column(4).to_pylist() if z else [b""] * len(texts), strict=True)]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *columns], names=["doc_id", "c1", "c2", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(of, f"doc_id {kind}, c1 long, c2 long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    check_cover(window, period, cover)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select("doc_id", "text", F.xxhash64("text").alias("c1"), F.xxhash64(F.lit("b"), "text").alias("c2"))

    # every text once, with its first document and that one's place in the order of all
    earliest_id = F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("first")
    texts = own.groupBy("c1", "c2").agg(earliest_id).select("c1", "c2", F.col("first.doc_id").alias("first"))
    keys = [F.asc_nulls_first("first"), "c1", "c2"]
    texts = materialise(texts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("ord", F.monotonically_increasing_id()))

    def of_firsts(wanted: DataFrame, *extra: str) -> DataFrame:
        w, d = wanted.alias("w"), zipped(own).alias("d")
        same = (F.col("d.c1") == F.col("w.c1")) & (F.col("d.c2") == F.col("w.c2")) & F.col("d.doc_id").eqNullSafe(F.col("w.first"))
        return d.join(w, same).select("d.doc_id", "d.c1", "d.c2", "d.z", *extra)

    anchors = repeated_anchors(send_anchors(own, buckets, window, period, cover), buckets)
    wanted = materialise(anchors.join(texts, "c1"))
    windows = later_windows(send_windows(of_firsts(wanted, "ord", "hashes"), buckets, window, period, cover), buckets)
    found = materialise(windows.join(texts, "ord").drop("ord"))
    changed = cut_texts(of_firsts(found, "starts"), window, True).select("c1", "c2", "n_removed", "kept_sha256").distinct()
    return assembled(cut_texts(own.select("doc_id", "c1", "c2", "text"), window, False), texts, changed, window)


def assembled(whole: DataFrame, texts: DataFrame, changed: DataFrame, window: int) -> DataFrame:
    """The result of every row: of equal texts the first document's first row is cut, and the others lose all windows."""
    counted = whole.groupBy("doc_id", "c1", "c2", "n_words", "kept_sha256").agg(F.count(F.lit(1)).alias("n"))
    each = counted.withColumn("no", F.explode(F.sequence(F.lit(1), F.col("n"))))
    f, e = texts.join(changed.withColumnRenamed("kept_sha256", "left_sha256"), ["c1", "c2"], "left").alias("f"), each.alias("e")
    # by the id as well, so that the copies of one text do not meet
    same = (F.col("e.c1") == F.col("f.c1")) & (F.col("e.c2") == F.col("f.c2")) & F.col("e.doc_id").eqNullSafe(F.col("f.first"))
    copy = (F.col("f.ord").isNull() | (F.col("no") > 1)) & (F.col("n_words") >= window)
    return e.join(f, same, "left").select(
        "e.doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("left_sha256", "kept_sha256")).alias("kept_sha256"))


def op12_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH own AS (
  SELECT row_number() OVER () AS no, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
starts AS (SELECT no, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM own WHERE len(w) >= 20),
ordered AS (SELECT no, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id ASC NULLS FIRST, no, i) AS r FROM starts),
gone AS (SELECT DISTINCT no, i + k AS p FROM (SELECT no, i, unnest(range(0, 20)) AS k FROM ordered WHERE r > 1)),
words AS (SELECT no, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM own),
kept AS (SELECT no, string_agg(word, ' ' ORDER BY p) AS line, count(*) AS n FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.no = words.no AND gone.p = words.p) GROUP BY no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM own LEFT JOIN kept USING (no)
"""
