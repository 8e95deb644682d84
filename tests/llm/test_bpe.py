import hashlib
import random

import public_tokenizers
import pytest
from llm_texts import TEXTS
from odd import run_everywhere

from whylake.llm import bpe


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary()), special_tokens={})


@pytest.fixture(scope="module")
def parts():
    return bpe.codec(bpe.vocabulary(), public_tokenizers.PATTERN)


def test_like_the_library(tiktoken_encoding, parts):
    draw = random.Random(2)
    tokens = list(bpe.read_ranks(bpe.vocabulary()))
    texts = list(TEXTS)
    for _ in range(400):
        texts.append("".join(draw.choice("aàéöß中文日本한국кириль   \n\n\t.,!?0123xyz'") for _ in range(draw.randint(0, 60))))
        texts.append("".join(chr(draw.choice([draw.randint(32, 0x2FF), draw.randint(0x4E00, 0x9FFF), draw.randint(0x1F300, 0x1F6FF)])) for _ in range(draw.randint(0, 30))))
        texts.append(b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 12))).decode("utf-8", "ignore"))
    for text in texts:
        n, ids_sha, decoded_sha, ids, decoded = bpe.encode_one(text, *parts, True)
        assert ids == tiktoken_encoding.encode_ordinary(text) and decoded == text and n == len(ids)
        assert decoded_sha == hashlib.sha256(text.encode()).hexdigest() and ids_sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_long_pieces_take_linear_time(parts):
    assert bpe.encode_one("ab" * 200_000 + " " * 200_000, *parts, False)[0] > 0


def test_small_tables_give_the_same(tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 5)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    machine = bpe.Transducer(bpe.read_ranks(bpe.vocabulary()))
    for text in ("antidisestablishmentarianism", "Donaudampfschifffahrt", "ééàß", "aaaaaaaaaaaaaaaaaaaaab"):
        assert machine.encode(text.encode()) == tiktoken_encoding.encode_ordinary(text)


def test_pairs_are_checked_without_merging_them(monkeypatch):
    machine = bpe.Transducer(bpe.read_ranks(bpe.vocabulary()))
    draw, tokens = random.Random(5), list(machine.reachable)
    pairs = [(draw.choice(tokens), draw.choice(tokens)) for _ in range(3000)]
    pairs += [(t[:k], t[k:]) for t in draw.sample(tokens, 2000) for k in range(1, len(t)) if t[:k] in machine.reachable and t[k:] in machine.reachable]
    pairs = [(machine.ranks[a], machine.ranks[b]) for a, b in pairs]
    expected = [machine.merged(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b] for a, b in pairs]
    assert True in expected and False in expected
    monkeypatch.setattr(machine, "merged", None)
    assert [machine.fits(a, b) for a, b in pairs] == expected


def test_merges_that_do_not_go_up_in_rank():
    ranks = {bytes((b,)): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258, b"aab": 259}
    machine = bpe.Transducer(ranks)
    assert machine.halves is None
    for text in (b"abc", b"aabc", b"aab", b"abcbcab", b"bcabaab"):
        # a whole token is taken as it is
        assert machine.encode(text) == ([ranks[text]] if text in ranks else machine.merged(text))


def test_decoding_as_tokens_come(tiktoken_encoding):
    decoder = bpe.StreamDecoder(bpe.Transducer(bpe.read_ranks(bpe.vocabulary())).bytes_of)
    text = "né 中文 \U0001f600 \U00012345 end"
    ids = [str(i).encode() for i in tiktoken_encoding.encode_ordinary(text)]
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text
    half = next(i for i, b in decoder.bytes_of.items() if not bpe.complete(b))
    assert "�" in decoder.feed([str(half).encode()]) + decoder.finish()
    assert decoder.feed(ids) == text  # nothing is left over


def test_odd_documents(odd_docs, no_docs, tiktoken_encoding):
    texts = {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    rows = bpe.encoded(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {(r.doc_id, r.decoded) for r in rows} == texts
    assert all(r.ids == tiktoken_encoding.encode_ordinary(r.decoded) for r in rows)
    assert bpe.encoded(no_docs).count() == 0


def test_query(spark, sf_tiny, tiktoken_encoding):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text").collect()}
    for r in run_everywhere(bpe.op8_byte_bpe, spark, sf_tiny).collect():
        ids = tiktoken_encoding.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
