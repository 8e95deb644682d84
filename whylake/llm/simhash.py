"""SimHash near-duplicates by bit-sliced comparison.

A text's 64-bit fingerprint has a bit where more than half of its shingle hashes have it.  Fingerprints link when they
differ in at most ``RADIUS`` bits, and linked documents form components.

Distinct fingerprints are placed in blocks: six bands of bits, one block for each two bands and their contents.  Four
differing bits leave two of six bands untouched, so no link is lost.  Inside a task the blocks lie sorted one after the
other and the bits stand in vertical planes, one bit of 64 rows in each word.  Row i is compared with row i + d for all
rows at once: plane by plane, the differing bits are added to carry-save counters, and words whose rows all exceed the
radius, or have no partner at that offset, are abandoned.  A block leaves only a spanning forest of its links, never all
pairs.  Large blocks are cut into chunks by a hash, and every two chunks meet in a block of their own, so nothing
unbounded is gathered in one task and no link is lost there either.  Forests are joined to components by alternating
star contraction.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other; a null document id never names a
component that has another id; repeated rows are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whylake.llm.common import fresh, if_small, materialise, table
from whylake.llm.words import slices

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bits of each band, from the lowest.
BANDS = (11, 11, 11, 11, 10, 10)
#: Rows of a block beyond which it is cut into chunks of about this many.
CHUNK = 1024


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    last = min(shingle, len(words)) - 1
    counts, total = np.zeros(64, np.int64), len(words) - last
    for lo in range(0, total, 25_500):
        hi = min(lo + 25_500, total)
        hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[lo:hi].tolist(), stops[lo + last : hi + last].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        even = len(bits) // 255 * 255  # sums of 255 bits fit in a byte
        counts += bits[:even].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[even:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED, extra: list[str] | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; and the columns ``extra``."""
    names = ["doc_id", *(extra or [])]
    own = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), *(extra or []))
    schema = T.StructType([own.schema[n] for n in names] + [T.StructField("fp", T.LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(v.as_py(), shingle, seed) for v in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], names=[*names, "fp"])

    return own.mapInArrow(of, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes: row k holds bit k of all fingerprints, 64 of them in a word; one word more than needed.

    A fingerprint is a number of 64 bits, or a row of several."""
    wide = fps.size // max(len(fps), 1) or 1
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8 * wide), axis=1, bitorder="little").T
    out = np.zeros((64 * wide, len(fps) // 64 + 2), "<u8")
    packed = np.packbits(bits, axis=1, bitorder="little")
    out.view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def shifted(words: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
    """The words at ``at`` of a plane moved down by ``by`` bits."""
    far, bit = divmod(by, 64)
    most = len(words) - 1
    low = words[np.minimum(at + far, most)]
    if not bit:
        return low
    return (low >> np.uint64(bit)) | (words[np.minimum(at + far + 1, most)] << np.uint64(64 - bit))


def linked_at(sliced: np.ndarray, wanted: np.ndarray, by: int, radius: int) -> np.ndarray:
    """Rows i (in ``wanted``, a bit for each row) whose distance to row i + ``by`` is at most ``radius``."""
    at = np.flatnonzero(wanted)
    alive = wanted[at]
    counters = [np.zeros(len(at), "<u8") for _ in range(radius.bit_length())]
    for k in range(len(sliced)):
        carry = (sliced[k][at] ^ shifted(sliced[k], at, by)) & alive
        for i, c in enumerate(counters):  # carry-save: add one bit to every row's counter
            counters[i], carry = c ^ carry, c & carry
        over = carry
        above = np.full(len(at), ~np.uint64(0))
        more = np.zeros(len(at), "<u8")
        for i in range(len(counters) - 1, -1, -1):  # counter > radius, bit by bit from the top
            if radius >> i & 1:
                above = above & counters[i]
            else:
                more = more | (above & counters[i])
                above = above & ~counters[i]
        alive = alive & ~(over | more)
        if k % 4 == 3:
            keep = np.flatnonzero(alive)
            if len(keep) < 0.75 * len(at):
                at, alive, counters = at[keep], alive[keep], [c[keep] for c in counters]
            if not len(at):
                return at
    rows = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
    return at[rows // 64] * 64 + rows % 64


def forest(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest of its component) inside sorted groups; a spanning forest, not all pairs."""
    n = len(fps)
    root, sliced, left = np.arange(n), planes(fps), behind(group)
    for by in range(1, int(left.max(initial=0)) + 1):
        bits = np.zeros(64 * sliced.shape[1], np.uint8)
        bits[:n] = left >= by
        found = linked_at(sliced, np.packbits(bits, bitorder="little").view("<u8"), by, radius)
        united(root, found, found + by)
    child = np.flatnonzero(root != np.arange(n))
    return fps[child], fps[root[child]]


def spanned(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest row of the component of each row, and the pairs of a minimum spanning forest of all within the radius.

    In each round every component takes the closest pair that leads out of it.
    """
    n = len(fps)
    a, b, apart = close_pairs(planes(fps), behind(group), radius)
    order = np.argsort(apart, kind="stable")
    a, b = a[order], b[order]
    root, joined = np.arange(n), [np.zeros((0, 2), np.int64)]
    while True:
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
        if not len(a):
            return root, np.concatenate(joined)
        first = np.full(n, len(a))
        for ends in (root[a], root[b]):
            np.minimum.at(first, ends, np.arange(len(a)))
        chosen = np.unique(first[first < len(a)])
        joined.append(np.stack([a[chosen], b[chosen]], axis=1))
        united(root, a[chosen], b[chosen])


def behind(group: np.ndarray) -> np.ndarray:
    """How many rows of its group come after each row."""
    n = len(group)
    if not n:
        return np.zeros(0, np.int64)
    last = np.concatenate([group[1:] != group[:-1], [True]])
    return np.flatnonzero(last)[np.cumsum(np.concatenate([[False], last[:-1]]))] - np.arange(n)


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the pairs, in place; a root is the smallest row of its component."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (jumped := root[root]).tobytes() != root.tobytes():
            root[:] = jumped


#: Words of 64 pairs whose distances are counted together.
TOGETHER = 4096


def close_pairs(sliced: np.ndarray, left: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, i + d of one group within the radius, and their distances.

    Words of rows at many offsets d are counted together: plane by plane, the differing bits are added to carry-save
    counters, and words whose rows all exceed the radius are abandoned.
    """
    out, held, words = [], [], 0
    for by in range(1, int(left.max(initial=0)) + 1):
        bits = np.zeros(64 * sliced.shape[1], np.uint8)
        bits[: len(left)] = left >= by
        wanted = np.packbits(bits, bitorder="little").view("<u8")
        at = np.flatnonzero(wanted)
        held.append((at, wanted[at], np.full(len(at), by)))
        words += len(at)
        if words >= TOGETHER:
            out.append(counted(sliced, *map(np.concatenate, zip(*held, strict=True)), radius))
            held, words = [], 0
    if words:
        out.append(counted(sliced, *map(np.concatenate, zip(*held, strict=True)), radius))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


def counted(sliced: np.ndarray, at: np.ndarray, alive: np.ndarray, by: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``close_pairs`` for the words ``at``, each with its own offset ``by``."""
    most = sliced.shape[1] - 1
    counters = [np.zeros(len(at), "<u8") for _ in range(radius.bit_length())]
    near, far = np.minimum(at + by // 64, most), np.minimum(at + by // 64 + 1, most)
    bit = (by % 64).astype(np.uint64)
    for k in range(len(sliced)):
        plane = sliced[k]
        # a shift by 64 is none in numpy, so the upper part is shifted in two steps
        moved = (plane[near] >> bit) | ((plane[far] << (np.uint64(63) - bit)) << np.uint64(1))
        carry = (plane[at] ^ moved) & alive
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        alive = alive & ~carry
        if k % 8 == 7:
            above, more = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), "<u8")
            for i in range(len(counters) - 1, -1, -1):
                if radius >> i & 1:
                    above = above & counters[i]
                else:
                    more, above = more | (above & counters[i]), above & ~counters[i]
            alive = alive & ~more
            keep = np.flatnonzero(alive)
            if len(keep) < 0.75 * len(at):
                at, by, alive, near, far, bit = at[keep], by[keep], alive[keep], near[keep], far[keep], bit[keep]
                counters = [c[keep] for c in counters]
            if not len(at):
                break
    rows = np.flatnonzero(np.unpackbits(np.ascontiguousarray(alive).view(np.uint8), bitorder="little"))
    word, place = rows // 64, (rows % 64).astype(np.uint64)
    apart = np.zeros(len(rows), np.int64)
    for i, c in enumerate(counters):
        apart += ((c[word] >> place & np.uint64(1)) << np.uint64(i)).astype(np.int64)
    first = at[word] * 64 + rows % 64
    return first, first + by[word], apart


def links(reps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """Links (u, v), v < u unsigned, that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    free = len(bands) - radius
    if free < 1:
        raise ValueError("there must be more bands than differing bits")
    lows = np.cumsum((0, *bands[:-1])).tolist()
    masks = [((1 << w) - 1) << lo for w, lo in zip(bands, lows, strict=True)]
    keys = []
    for n, chosen in enumerate(combinations(masks, free)):
        mask = sum(chosen)
        keys.append(F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    blocks = reps.select("fp", F.inline(F.array(*keys)))

    def found(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return forest(rows[0].view("<u8"), rows[1], radius)

    placed = chunked(blocks, "fp", chunk).repartition("block").sortWithinPartitions("block", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))))
    return compared(placed.select("fp", "block"), found)


def chunked(blocks: DataFrame, row: str, chunk: int) -> DataFrame:
    """Rows with (t, key) as rows with ``block``: blocks of one row are left out; large ones are cut into chunks by a hash, and
    every two chunks meet in a block of their own."""
    sizes = blocks.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    cut = blocks.join(sizes, ["t", "key"]).withColumns({"own": F.pmod(F.xxhash64(row), chunks).cast("int"), "other": F.explode(F.sequence(F.lit(0), chunks - 1))})
    return cut.withColumn("block", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other"))).drop("t", "key", "n", "own", "other")


def compared(placed: DataFrame, found: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Distinct links (u, v) that ``found`` gives for whole blocks of the sorted rows (longs, the last of them ``block``)."""
    width = len(placed.columns)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(0, np.int64) for _ in range(width)]

        def sent(part: list[np.ndarray]) -> pa.RecordBatch:
            u, v = found(part)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            rows = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rows)]
            block = rows[-1]
            whole = int(np.flatnonzero(block != block[-1])[-1]) + 1 if len(block) and block[0] != block[-1] else 0
            if whole:  # the last block may go on in the next batch
                yield sent([r[:whole].copy() for r in rows])
                rows = [r[whole:] for r in rows]
        if len(rows[-1]):
            yield sent(rows)

    return placed.mapInArrow(of, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): alternating star contraction until nothing moves."""
    stars, before = materialise(edges.where("u <> v")), None
    while True:
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        after = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        after = after.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        stars = materialise(after)
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def rooted(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (doc_id, fp and more) with ``root``, the fingerprint that names their component, and ``component_id``."""
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(reps, radius))
    named = reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = materialise(named.groupBy("root").agg(F.min("first").alias("component_id")))
    # written, so that a component of many fingerprints is dealt out by Spark's skew join
    named = materialise(materialise(named.select("fp", "root")).join(smallest, "root"))
    return rows.join(named, "fp")


def near_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id of all documents that can be reached over links, for every row."""
    return rooted(materialise(fingerprints(docs, text, doc_id)), radius).select("doc_id", "fp", "component_id")


def keyed(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with names for the key of a row: two hashes of its id and text, which only equal rows share."""
    one, two = fresh(docs, "__one"), fresh(docs, "__two")
    whole = [F.col(doc_id), F.col(text)]
    return docs.withColumn(one, F.xxhash64(*whole)).withColumn(two, F.xxhash64(F.lit("two"), F.col(text).isNull(), *reversed(whole))), [one, two]


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without near-duplicates: of each component one row with the smallest id stays.

    Where several rows have that id, or a component has no id at all, it is one with the smallest fingerprint among them.
    Fingerprints are made once; rows are found again by the hashes of their id and text.
    """
    own, key = keyed(docs, text, doc_id)
    rows = own.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(key[0]).alias("one"), F.col(key[1]).alias("two"))
    return first_of_each(docs, own, key, rooted(materialise(fingerprints(rows, extra=["one", "two"]))))


def first_of_each(docs: DataFrame, own: DataFrame, key: list[str], found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` in ``found`` (doc_id, fp, root, one, two); ``own`` has them with their keys."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "one", "two")
    kept = found.groupBy("doc_id", "fp", "root", "one", "two").agg(F.count(F.lit(1)).alias("n"))
    kept = materialise(kept.groupBy("root").agg(F.min_by(F.struct("one", "two", "n"), order).alias("k")).select("k.*"))
    same = (F.col(f"d.{key[0]}") == F.col("k.one")) & (F.col(f"d.{key[1]}") == F.col("k.two"))
    single = own.alias("d").join(kept.where("n = 1").alias("k"), same, "left_semi")
    several = own.alias("d").join(if_small(kept.where("n > 1")).alias("k"), same, "left_semi").dropDuplicates(key)
    return single.unionByName(several).select(*docs.columns)


# --- near-duplicates by similarity -------------------------------------------------------
# Documents whose shingles of five words have a Jaccard similarity of 0.8 or more differ in more bits of a fingerprint than
# blocks of equal bits could find.  Here blocks are formed by bands of minimal hashes, fingerprints have 512 bits, and the pairs that
# the bit planes leave are verified by their shingles.

WIDE, WORDS, LIKE = 8, 5, 0.8
#: Bands and minimal hashes in each: two documents of similarity 0.8 share a band with a probability of 0.995.
MIN_BANDS, MIN_ROWS = 10, 4
#: Of 512 bits; documents of similarity 0.8 differ in 78 of them, with a deviation of 8.
WIDE_RADIUS = 102
PRINT = [f"f{w}" for w in range(WIDE)]


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; of a shorter text the whole, of an empty one none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    last = min(size, len(words)) - 1
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b]) for a, b in zip(starts[: len(words) - last].tolist(), stops[last:].tolist(), strict=True)), np.uint64))


def wide_print(h: np.ndarray) -> np.ndarray:
    """512 bits: in each, what more than half of the hashes have, mixed anew for every 64 of them."""
    out = np.zeros(WIDE, np.uint64)
    for w in range(WIDE):
        counts = np.zeros(64, np.int64)
        for lo in range(0, len(h), 1 << 16):
            bits = np.unpackbits(mixed(h[lo : lo + (1 << 16)], w + 1).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
    return out


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each band of minimal hashes."""
    if not len(h):
        return [0] * MIN_BANDS
    least = np.array([mixed(h, 100 + i).min() for i in range(MIN_BANDS * MIN_ROWS)], np.uint64).reshape(MIN_BANDS, MIN_ROWS)
    key = np.zeros(MIN_BANDS, np.uint64)
    for i in range(MIN_ROWS):
        key = mixed(key ^ least[:, i], 7)
    return key.view(np.int64).tolist()


def profiles(rows: DataFrame) -> DataFrame:
    """(doc_id, one, two, node, f0 … f7, bands, grams): shingles of each text, and what is made of them; ``node`` names the set."""
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("one", "two", "node", *PRINT)),
                           T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("grams", T.BinaryType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part in slices(batch, 3):
                sets = [shingles(t.as_py()) for t in part.column(3)]
                prints = np.array([wide_print(h) for h in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
                nodes = np.array([xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
                # four bytes of a hash tell two shingles of one pair apart well enough for a share of them
                grams = pa.array([np.unique(h >> np.uint64(32)).astype("<u4").tobytes() for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    *(part.column(i) for i in range(3)), pa.array(nodes), *(pa.array(prints[:, w]) for w in range(WIDE)),
                    pa.array([band_keys(h) for h in sets], pa.list_(pa.int64())), grams], names=schema.names)

    return rows.select("doc_id", "one", "two", "text").mapInArrow(of, schema)


def similar_pairs(nodes: DataFrame, radius: int = WIDE_RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Pairs (u, v) of distinct shingle sets (node, f0 … f7, bands) that share a band and lie within the radius: the closest of them that
    connect all that do."""
    blocks = nodes.select("node", *PRINT, F.posexplode("bands").alias("t", "key"))

    def found(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        _, pairs = spanned(np.stack(rows[1 : 1 + WIDE], axis=1).view("<u8"), rows[-1], radius)
        a, b = rows[0][pairs[:, 0]], rows[0][pairs[:, 1]]
        return np.maximum(a, b), np.minimum(a, b)

    return compared(chunked(blocks, "node", chunk).repartition("block").sortWithinPartitions("block", "node").select("node", *PRINT, "block"), found)


def verified(pairs: DataFrame, sets: DataFrame, like: float = LIKE) -> DataFrame:
    """The pairs (u, v) whose sets (node, grams) are alike."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= like * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(of, "u long, v long")


def keep_one_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", like: float = LIKE) -> DataFrame:
    """The documents without near-duplicates of similarity ``like`` or more: of each component one row with the smallest id stays.

    Equal sets of shingles are one node.  A pair that the planes leave and the shingles refute connects nothing, so no document goes
    without one that is alike, at whatever number of steps.  Cases as for ``keep_one``; texts without words are alike.
    """
    own, key = keyed(docs, text, doc_id)
    rows = own.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(key[0]).alias("one"), F.col(key[1]).alias("two"))
    known = materialise(profiles(rows))
    nodes = known.select("node", *PRINT, "bands").dropDuplicates(["node"])
    pairs = materialise(similar_pairs(nodes))
    ends = materialise(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    sets = known.select("node", "grams").join(ends, "node", "left_semi").dropDuplicates(["node"])
    roots = components(verified(pairs, materialise(sets), like)).withColumnRenamed("root", "of")
    found = known.select("doc_id", "one", "two", F.col("node").alias("fp")).join(roots, F.col("fp") == F.col("node"), "left")
    return first_of_each(docs, own, key, found.select("doc_id", "fp", "one", "two", F.coalesce("of", "fp").alias("root")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
