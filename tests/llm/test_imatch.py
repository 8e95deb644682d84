import hashlib

from odd import run_everywhere
from pyspark.sql import functions as F

from whylake.llm import common, imatch


def test_odd_documents(odd_docs, no_docs):
    rows = imatch.edited(odd_docs).collect()
    order = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "", r.doc_id) for r in odd_docs.collect()), key=lambda r: (-r[0], r[1]))
    want = []
    for i, (_, text, doc) in enumerate(order):
        half = len(text) // 2
        want.append((str(doc), text[: len(text) - half] + order[(i + 1) % len(order)][1][:half]))
    assert sorted((str(r.doc_id), r.edited) for r in rows) == sorted(want)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(tuple(r.signatures))
        by_text.setdefault(r.edited, set()).add(tuple(r.edited_signatures))
    assert all(len(s) == 1 for s in by_text.values())
    assert imatch.edited(no_docs).count() == 0


def test_distant_ids_follow_one_another(spark):
    """Runs and levels with gaps, negative ids, and the wrap-around."""
    ids = [-(1 << 40), -1, 0, 5, 255, 256, 1 << 20, (1 << 20) + 1, 1 << 33, 1 << 62]
    docs = spark.createDataFrame([(i, f"text number {i} here") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.edited for r in imatch.edited(docs).collect()}
    for n, i in enumerate(ids):
        text, after = f"text number {i} here", f"text number {ids[n - 1]} here"
        half = len(text) // 2
        assert got[i] == text[: len(text) - half] + after[:half]


def test_lexicon_is_the_band(spark, words):
    """Terms of one in a hundred texts are in it, those of every text and of one in ten thousand are not."""
    docs = spark.range(1, 20_001).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.lit("everywhere"), F.concat(F.lit("some"), F.col("id") % 100), F.when(F.col("id") <= 2, "rare")).alias("text"))
    bitmap = imatch.lexicon(docs)
    terms = spark.createDataFrame([("everywhere",), ("rare",), ("some7",), ("some42",)], "t string")
    got = {r.t: r.kept for r in terms.withColumn("b", bitmap.scalar()).select("t", common.in_bitmap("b", F.xxhash64("t")).alias("kept")).collect()}
    assert got == {"everywhere": False, "rare": False, "some7": True, "some42": True}


def test_likeness_follows_shared_terms(spark, words):
    """Half-edited texts are alike, unrelated ones are not; more shared terms, more alike."""
    import random

    draw = random.Random(1)
    vocabulary = [a + b for a in words for b in words[:20]]
    texts = [" ".join(draw.choices(vocabulary, k=300)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = imatch.edited(docs).select(
        F.avg(imatch.likeness(F.col("signatures"), F.col("edited_signatures"))).alias("edited"),
        F.avg(imatch.likeness(F.col("signatures"), F.col("next_signatures"))).alias("next"),
        F.min(imatch.likeness(F.col("signatures"), F.col("signatures"))).alias("own")).first()
    assert r.own == 1.0 and r.next < 0.1 < 0.2 < r.edited < 0.6


def test_query(spark, sf_tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows = run_everywhere(imatch.op4_imatch, spark, sf_tiny).collect()
    prints = {}
    for r in rows:
        text, half = docs[r.doc_id], len(docs[r.doc_id]) // 2
        edited = text[: len(text) - half] + docs[after[r.doc_id]][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(text, set()).add(r.fingerprint)
    assert len(rows) == len(docs) and all(len(p) == 1 for p in prints.values())
    assert sum(r.near_edited > r.near_next for r in rows) > 0.8 * len(rows)
