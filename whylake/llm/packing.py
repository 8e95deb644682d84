"""Packing along a space-filling curve.

Every document becomes token ids and a small hashed vector of them; a fixed random projection takes the vector to four
coordinates, whose place on a Hilbert curve is the sort key.  Documents are range-sorted by that key and cut into
sequences in curve order, so a sequence holds texts that resemble one another and exact copies lie side by side.

Each range is packed on its own.  What is left at its end, less than one sequence, is cut into lengths that are powers
of two, which need no padding.  No global position is computed, so there is no step in a single task.

Cases: a null or empty text is its end id alone; a null document id is kept as null; repeated rows are packed each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whylake.llm.common import materialise, table

LENGTH = 4096
END = 2
BUCKETS, DIMENSIONS, BITS = 64, 4, 15
#: Words that one Python worker remembers with their ids in each of two generations; the older one is dropped when full.
REMEMBERED = 400_000
#: Letters below this one (Latin with its first extension) are composed, and fold case one by one.
LATIN_END = "\u0180"
#: Byte-level vocabularies spell a byte that is no printable character as the next letter from 256 on.
BYTE_LETTERS = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)), map(chr, range(256, 512)), strict=False))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def word_ids(path: str, end: int):
    """A function from an array of texts to their ids.

    The vocabulary drops white space and never joins characters across it, so a text's ids are those of its words.
    Words repeat far more than texts, so each is encoded once while it is remembered.  New words of plain Latin letters
    go to the library's merges directly, since normalising and splitting would leave them as they are; other new words
    are encoded many at a time, kept apart by a bar, which is one id by itself.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    encode_all, merge = tokenizer.encode_batch_fast, tokenizer.model.tokenize
    (bar,) = tokenizer.encode("|", add_special_tokens=False).ids
    last = np.array([end], "<u4").tobytes()
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def learn(words: list[str]) -> None:
        plain, odd = [], []
        for w in words:
            if w.isalpha() and w.islower() and max(w) < LATIN_END:
                spelt = w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS)
                known[w] = np.array([t.id for t in merge(spelt)], "<u4").tobytes()
            else:
                (odd if "|" in w or "<" in w else plain).append(w)
        for lo in range(0, len(plain), 256):
            part = plain[lo : lo + 256]
            ids = np.array(encode_all([" | ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(ids == bar).tolist()
            if len(edges) != len(part) - 1:
                raise ValueError("the vocabulary does not keep words apart")
            packed, begin = ids.tobytes(), 0
            for word, stop in zip(part, [*edges, len(ids)], strict=True):
                known[word] = packed[4 * begin : 4 * stop]
                begin = stop + 1
        for word, e in zip(odd, encode_all(odd, add_special_tokens=False), strict=True):
            known[word] = np.array(e.ids, "<u4").tobytes()

    def look_up(words: list[str]) -> list[bytes]:
        nonlocal known, older
        if len(known) > REMEMBERED:
            known, older = {}, known
        missing, cores = [], {}
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                    continue
                missing.append(w)
                # letters end where a stop or comma begins, and the vocabulary folds case: look for the bare word
                core = w[:-1] if w[-1:] in (".", ",") else w
                cores[w] = core.lower() if core.isalpha() and max(core) < LATIN_END and "İ" not in core else w
        learn(list({c for c in (*cores.values(), ".", ",") if c not in known}))
        for w in missing:
            core = cores[w]
            known[w] = known[core] + known[w[-1]] if len(w) > len(core) else known[core]
        return [known[w] for w in words]

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text begins in them (one more place than texts)."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        places = words.values.slice(words.offsets[0].as_py(), words.offsets[-1].as_py() - words.offsets[0].as_py()).dictionary_encode()
        entries = [*look_up(places.dictionary.to_pylist()), last]
        bounds = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        index = np.insert(places.indices.to_numpy(), bounds[1:], len(entries) - 1)
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        flat = np.frombuffer(b"".join(entries), "<u4")
        own = sizes[index]
        stops = np.cumsum(own)
        at = np.arange(stops[-1] if len(stops) else 0) + np.repeat((np.cumsum(sizes) - sizes)[index] - (stops - own), own)
        starts = np.concatenate([[0], stops])[bounds + np.arange(len(bounds))]
        return flat[at], starts

    return encode


@cache
def projection(buckets: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(1).standard_normal((buckets, dimensions))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits`` bits in each coordinate; neighbours on it are neighbours."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curve_keys(flat: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hash each document's ids into a signed vector of ``buckets``, project it, and find its place on the curve."""
    hashed = ((flat * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(2 * buckets)
    n = len(starts) - 1
    counts = np.bincount(np.repeat(np.arange(n) * 2 * buckets, np.diff(starts)) + hashed, minlength=2 * buckets * n).reshape(n, -1)
    vectors = np.sqrt(counts[:, :buckets]) - np.sqrt(counts[:, buckets:])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    points = vectors @ projection(buckets, dimensions)
    cells = np.clip((np.tanh(points) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_keys(cells, bits)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, so that long texts do not add up in memory."""
    sizes = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)], dtype=np.int64)
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield batch.slice(lo, hi - lo)


def tokenised(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end: int = END) -> DataFrame:
    """(doc_id, curve_key, n, ids): ids as unsigned 32-bit little-endian bytes."""
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("curve_key", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path, end)
        for whole in batches:
            for batch in slices(whole, 1):
                flat, starts = ids_of(batch.column(1))
                ids = [flat[a:b] for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(curve_keys(flat, starts)), pa.array(np.diff(starts)),
                     pa.array([shrink(x) for x in ids], pa.binary())], names=["doc_id", "curve_key", "n", "ids"])

    return rows.mapInArrow(encode, schema)


def shrink(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four; a leading byte tells."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\4" + ids.tobytes()


def widen(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[:1] == b"\2" else "<u4", offset=1).astype("<u4")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id",
         end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    keyed = tokenised(docs, path or vocabulary(), text, doc_id, end).withColumn("tie", F.xxhash64("doc_id", "ids"))
    once = materialise(keyed)
    # the second sort column spreads a run of equal keys, as copies have, over several ranges
    ordered = once.repartitionByRange("curve_key", "tie").sortWithinPartitions("curve_key", "tie", "doc_id")
    kind = once.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        done = 0  # sequences closed in this range
        open_pieces: list[tuple] = []  # (doc, start, ids, tokens of the document), under one sequence in all
        held = 0
        ready: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal done
            offset = 0
            for doc, start, ids, total in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + done, offset)
                ready.append((*row, ids.tolist()) if with_ids else row)
                offset += len(ids)
            done += 1

        def rows() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True)) if ready else [()] * len(schema.fields)
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.fieldNames())

        types = [None] + [pa.int64()] * 6 + [pa.list_(pa.int64())] * with_ids
        for batch in batches:
            types[0] = batch.column(0).type
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, start = widen(packed), 0
                while start < len(ids):
                    take = min(length - held, len(ids) - start)
                    open_pieces.append((doc, start, ids[start : start + take], len(ids)))
                    start += take
                    held += take
                    if held == length:
                        close(open_pieces)
                        open_pieces, held = [], 0
                if len(ready) >= (64 if with_ids else 20_000):
                    yield rows()
        while held:  # the rest of the range, by the binary digits of its size
            size = 1 << (held.bit_length() - 1)
            part, rest, room = [], [], size
            for doc, start, ids, total in open_pieces:
                take = min(room, len(ids))
                if take:
                    part.append((doc, start, ids[:take], total))
                if take < len(ids):
                    rest.append((doc, start + take, ids[take:], total))
                room -= take
            close(part)
            open_pieces, held = rest, held - size
        if ready:
            yield rows()

    return ordered.select("doc_id", "ids").mapInArrow(cut, schema)


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
