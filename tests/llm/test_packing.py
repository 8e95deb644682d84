import random
import zlib

import numpy as np
from odd import run_everywhere

from whylake.llm import packing


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary()).encode(text or "", add_special_tokens=False).ids + [packing.END]


def check(rows, texts, length):
    """Each id in one piece, sequences gapless, padding only where a length is no power of two."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert {k for k, _ in pieces} == {k for k, _ in texts}
    for doc, text in texts:
        ids = np.array(ids_of(text), "<u4")
        own = sorted((r for (d, n), rs in pieces.items() if d == doc and n == len(ids) for r in rs), key=lambda r: r.start)
        assert {zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own} == {r.ids_crc32 for r in own}
        copies = sum(1 for d, t in texts if d == doc and len(ids_of(t)) == len(ids))
        assert sum(r.length for r in own) == len(ids) * copies
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        at = 0
        for r in rs:
            assert r.offset == at
            at += r.length
        assert at == length or at & (at - 1) == 0 and at < length


def test_pieces(spark, odd_docs):
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows = packing.pack(odd_docs, length=64).collect()
    check(rows, texts, 64)
    full = packing.pack(odd_docs, length=64, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in full)


def test_words_are_encoded_as_texts():
    import pyarrow as pa

    from llm_texts import TEXTS

    flat, starts = packing.word_ids(packing.vocabulary(), packing.END)(pa.array(TEXTS))
    for text, a, b in zip(TEXTS, starts, starts[1:], strict=False):
        assert flat[a:b].tolist() == ids_of(text)


def test_hilbert_curve_visits_every_cell_in_unit_steps():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark, words):
    draw = random.Random(1)
    topics = [draw.sample(words, 12) for _ in range(4)]
    rows = [(i, " ".join(draw.choices(topics[i % 4], k=80))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.doc_id % 4 for r in packing.pack(docs).orderBy("sequence_id", "offset").collect()]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 40  # 20 by chance


def test_empty(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_query(spark, sf_tiny):
    run_everywhere(packing.op1_curve_packing, spark, sf_tiny)
