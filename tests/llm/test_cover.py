import hashlib
import random
import re

import pytest

from whylake.llm import cover


def expected(rows, window=20):
    """Every window of every row against all earlier ones."""
    split = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (split[i][0] is not None, split[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        d, words = split[i]
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((str(d), len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_cover_covers():
    cover.check_cover(cover.WINDOW, cover.PERIOD, cover.COVER)
    with pytest.raises(ValueError):
        cover.check_cover(20, 13, (0, 1, 3))
    with pytest.raises(ValueError):
        cover.check_cover(5, 7, (0, 1, 3))


@pytest.fixture(scope="module")
def passages(words):
    """Shared passages of 18 to 60 words at all offsets, copies, near copies and a frequent line."""
    draw = random.Random(3)
    shared = [[draw.choice(words) for _ in range(n)] for n in (18, 19, 20, 21, 25, 33, 60)]
    rows = []
    for i in range(150):
        out = []
        for _ in range(draw.randint(0, 4)):
            out += [draw.choice(words) for _ in range(draw.randint(0, 30))]
            if draw.random() < 0.7:
                out += draw.choice(shared)
        rows.append((draw.randrange(10**6), draw.choice([" ", "\n", " \t"]).join(out)))
    rows += [(5000 + i, rows[3][1]) for i in range(20)] + [(3, rows[4][1] + " tail"), (2, rows[4][1].replace(" ", "\n"))]
    rows += [(7000 + i, "again and again the same line " * (3 * i)) for i in range(6)] + [(8000, "one " * 500), (8001, "one " * 19), (None, rows[3][1])]
    return rows


def test_windows_by_brute_force(spark, passages):
    assert got(cover.without_repeats(frame(spark, passages))) == expected(passages)


def test_small_steps(spark, passages, monkeypatch):
    """Everything settled between buckets, and little within a task."""
    monkeypatch.setattr(cover, "GATHERED", 60)
    assert got(cover.without_repeats(frame(spark, passages, 9))) == expected(passages)


def test_other_windows(spark, passages):
    docs = frame(spark, passages[:80])
    assert got(cover.without_repeats(docs, window=8, period=7, cover=(0, 1, 3))) == expected(passages[:80], 8)
    assert got(cover.without_repeats(docs, window=3, period=1, cover=(0,))) == expected(passages[:80], 3)


def test_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.union(odd_docs.where("doc_id in (10, 11, 12, 13)"))
    assert got(cover.without_repeats(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert cover.without_repeats(no_docs).count() == 0


def test_query(spark, sf_tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()]
    assert got(cover.op12_cover_dedup(spark, sf_tiny)) == expected(rows)
