import math
import random
import re
from collections import Counter

import pytest

from whylake.llm import bags

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def expected(docs, items, top=10):
    """Every score of every document by the plain formula."""
    held = [(d, c) for d, t in docs if (c := Counter(terms(t)))]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for i, text in items:
        rows = []
        for d, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(rows)[:top])]
    return sorted(map(str, out))


def got(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def corpus(words):
    draw = random.Random(9)
    docs = [(i, " ".join(draw.choices(words[:60], k=draw.randint(0, 30)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(900 - i, docs[7][1].upper() + ", ! zzz") for i in range(20)]
    docs += [(None, docs[5][1]), (3, docs[5][1]), (3, docs[5][1]), (2000, None), (2001, " .,- "), (2002, "É é ÀB ab_cd 12a"), (2003, "ab cd " * 3000)]
    items = [(i, " ".join(draw.choices(words[:70], k=12))) for i in range(12)] + [(50, None), (51, "nowhere"), (52, "é À AB cd 12A"), (53, docs[5][1]), (54, "")]
    return docs, items


def test_ranking_by_brute_force(spark, corpus):
    docs, items = corpus
    d, i = frames(spark, docs, items)
    assert got(bags.ranked(d, i)) == expected(docs, items)


def test_blocks_of_items(spark, corpus):
    """Small vocabularies make several blocks, with the same result."""
    docs, items = corpus[0][:120] + corpus[0][300:345], corpus[1][:5]
    d, i = frames(spark, docs, items)
    assert bags.blocks_of(bags.item_terms(i, "text", "item_id"), 25)[1] > 1
    assert got(bags.ranked(d, i, most_terms=25)) == expected(docs, items)


def test_steps_and_large_joins(spark, corpus, monkeypatch):
    """The same rows with the smallest steps of scoring, and without a broadcast."""
    docs, items = corpus[0][:150], corpus[1][:6]
    monkeypatch.setattr(bags, "PAIRS", 40)
    monkeypatch.setattr(bags, "if_small", lambda df: df)
    d, i = frames(spark, docs, items)
    assert got(bags.ranked(d, i, top=3)) == expected(docs, items, 3)


def test_equal_hashes_make_no_class(spark, monkeypatch):
    """Bags of one hash are told apart by their contents."""
    from pyspark.sql import functions as F

    docs, items = [(1, "a b"), (2, "a c"), (3, "a b"), (4, "c c")], [(0, "b"), (1, "c")]
    d, i = frames(spark, docs, items)
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7) if c == ("m", "bag") else real(*c))
    assert got(bags.ranked(d, i)) == expected(docs, items)


def test_odd_documents(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "same text word idiot"), (2, None), (1, "word x")]
    i = spark.createDataFrame(items, "item_id long, text string")
    assert got(bags.ranked(odd_docs, i)) == expected(docs, items)
    assert bags.ranked(no_docs, i).count() == 0 and bags.ranked(odd_docs, i.limit(0)).count() == 0


def test_query(spark, sf_tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_tiny}/benchmark.parquet").collect()]
    assert got(bags.op11_bag_search(spark, sf_tiny)) == expected(docs, items)
