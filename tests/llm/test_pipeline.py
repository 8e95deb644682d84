import corpus_pipeline
from odd import components
from test_simhash import jaccard


def test_stages_by_brute_force(spark, sf_tiny):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["language_id", "toxicity", "near_dedup", "pii", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = named["language_id"](spark, docs, sf_tiny)
    assert {r.doc_id for r in known.collect()} == {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}
    clean = named["toxicity"](spark, known, sf_tiny)
    assert clean.columns == docs.columns and 0.8 * known.count() < clean.count() <= known.count()
    once = named["near_dedup"](spark, clean, sf_tiny)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    pairs = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[:i] if jaccard(s, t) >= 0.8]
    kept, firsts = {r.doc_id for r in once.collect()}, set(components([d for d, _ in rows], pairs).values())
    assert firsts <= kept and len(kept) <= len(firsts) + 1 and len(firsts) < len(rows)
    covered = named["pii"](spark, once, sf_tiny)
    assert covered.columns == docs.columns and {r.doc_id for r in covered.collect()} == kept
    assert all("@mail" not in r.text and r.n_chars == len(r.text) for r in covered.collect())
    packed = named["packing"](spark, covered, sf_tiny).collect()
    assert {r.doc_id for r in packed} == kept


def test_odd_documents(spark, odd_docs, no_docs, sf_tiny):
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_tiny)
            assert docs.columns == odd_docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_tiny)
        assert (out.count() > 0) == (start is odd_docs)


def test_run(spark, sf_tiny):
    out = corpus_pipeline.run(spark, sf_tiny)
    assert out.count() > 0 and "sequence_id" in out.columns
