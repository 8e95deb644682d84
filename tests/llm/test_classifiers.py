import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from odd import run_everywhere
from pyspark.sql import functions as F

from whylake.llm import langid, toxicity
from whylake.llm.common import labelled_sample, remainder
from whylake.llm.words import Remembered


@pytest.fixture(scope="module")
def languages(spark):
    """Invented languages of different syllables."""
    draw = random.Random(8)
    syllables = {"en": ["th", "er", "ing", "on"], "fr": ["eux", "ou", "é", "tion"], "de": ["sch", "ü", "ver", "ß"]}
    rows = []
    for i in range(300):
        lang = draw.choice(list(syllables))
        text = " ".join("".join(draw.choices(syllables[lang], k=3)) for _ in range(draw.randint(3, 60)))
        rows.append((i, text, lang if i % 7 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_remainder_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", remainder("id", 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_languages(languages):
    model = langid.learn(languages, langid.training_labels(languages))
    got = langid.identified(languages, model).select("truth", "lang_pred", "score").collect()
    assert np.mean([r.truth == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_kernel_is_the_cosine_of_gram_sets():
    texts = ["the thing on", "on the thing", "völlig anders", "a"]
    marks, _ = langid.presences(texts)
    model = langid.KernelRidge(marks, ["a", "a", "b", "b"])
    k = model.kernel(marks)
    landmarks = np.unpackbits(model.landmarks, axis=1, count=langid.WIDTH)
    for i, a in enumerate(marks):
        for j, b in enumerate(landmarks):
            assert abs(k[i, j] - (a & b).sum() / np.sqrt(a.sum() * b.sum())) < 1e-5


def test_stretches_do_not_change_a_text(monkeypatch):
    text = "some text, ÜBER lines\nand 12 numbers " * 20
    whole = langid.presences([text])[0]
    monkeypatch.setattr(langid, "STRETCH", 7)
    assert (langid.presences([text])[0] == whole).all()


def test_odd_languages(odd_docs, no_docs):
    model = langid.learn(odd_docs, langid.training_labels(odd_docs))
    rows = langid.identified(odd_docs, model).collect()
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and (r.score == 0) == (not lettered)
    assert langid.identified(odd_docs, model).columns == [*odd_docs.columns, "lang_pred", "score"]
    nothing = langid.learn(no_docs, langid.training_labels(no_docs))
    assert {r.lang_pred for r in langid.identified(odd_docs, nothing).collect()} == {"und"}
    assert langid.identified(no_docs, model).count() == 0


def test_language_query(spark, sf_tiny):
    df = run_everywhere(langid.op9_string_kernel, spark, sf_tiny).join(spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = df.where("held_out")
    assert held.where("lang = lang_pred").count() > 0.95 * held.count()
    assert df.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) != F.col("held_out")).count() == 0


@pytest.fixture(scope="module")
def insults(words):
    """Texts of 20 to 300 words; toxic ones hold one to three of five insults or their inflections."""
    draw, rows = random.Random(9), []
    for _ in range(500):
        text = draw.choices(words, k=draw.randint(20, 300))
        toxic = draw.random() < 0.3
        for _ in range(draw.randint(1, 3) if toxic else 0):
            text.insert(draw.randrange(len(text)), draw.choice(["idiot", "moron", "loser", "pathetic", "scum"]) + draw.choice(["", "s", "!", ","]))
        rows.append((" ".join(text), int(toxic)))
    return rows


def test_toxicity_and_misspellings(insults):
    model = toxicity.SubwordSoftmax([t for t, _ in insults[:350]], [y for _, y in insults[:350]])
    scores = model.scores(pa.array([t for t, _ in insults[350:]]), Remembered(model.of_words))
    truth = np.array([y for _, y in insults[350:]])
    assert (scores[truth == 1] >= toxicity.THRESHOLD).mean() > 0.9 and (scores[truth == 0] >= toxicity.THRESHOLD).mean() < 0.05
    plain = insults[0][0].split()[:15]
    known, bent, clean = model.scores(pa.array([" ".join([*plain, w]) for w in ("idiot", "idiiot", plain[0])]), Remembered(model.of_words))
    assert known > 0.7 and bent > clean


def test_windows():
    doc = np.array([0, 0, 0, 0, 2, 5, 5])
    first, last = toxicity.windows(doc)
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == [(0, 3), (1, 4), (4, 5), (5, 7)]


def test_subwords_are_the_ngrams():
    grams, sizes = toxicity.subwords(["Abc,", "", "x"])
    assert sizes.tolist() == [3 + 2 + 1, 1, 1]  # <abc>, <>, <x>
    again, one = toxicity.subwords(["abc"])
    assert one.tolist() == [6] and again.tolist() == grams[:6].tolist()


def test_odd_toxicity(spark, odd_docs, no_docs):
    one_class = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, label int")
    rows = toxicity.scored(odd_docs, toxicity.learn(odd_docs, one_class)).collect()
    assert {r.score for r in rows} == {0.0}
    both = spark.createDataFrame([(3, 0), (8, 0), (10, 1), (None, 1), (4, None)], "doc_id long, label int")
    model = toxicity.learn(odd_docs, both)
    out = toxicity.scored(odd_docs, model)
    assert out.columns == [*odd_docs.columns, "score"]
    for r in out.collect():
        assert 0 <= r.score <= 1 and ((r.text or "").strip() or r.score == 0)
    assert toxicity.scored(no_docs, model).count() == 0


def test_toxicity_query(spark, sf_tiny):
    df = run_everywhere(toxicity.op5_subword_softmax, spark, sf_tiny)
    assert df.where("(score >= 0.7) <> (predicted = 1) or score not between 0 and 1").count() == 0


@pytest.mark.parametrize("query", [langid.op9_string_kernel, toxicity.op5_subword_softmax])
def test_queries_take_null_repeated_and_text_ids(spark, odd_docs, tmp_path, query):
    both = odd_docs.union(odd_docs.where("doc_id < 4"))
    for name, kind in (("a", "long"), ("b", "string")):
        folder = tmp_path / name
        both.withColumn("doc_id", F.col("doc_id").cast(kind)).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, 1), (3, 0), (8, 0), (10, 1), (10, 1)], "doc_id long, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind)).write.parquet(f"{folder}/labels.parquet")
        out = query(spark, str(folder))
        assert out.count() == both.count() and out.where("held_out is null").count() == 0


def test_a_label_is_filled_up_to_its_bound(spark):
    """Long texts, missing documents and repeated ids do not use up places of the sample."""
    rows = [(i, "x" * (900 if i % 2 else 10)) for i in range(200)] + [(i, f"second text of {i}") for i in range(0, 200, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a" if i < 160 else "b") for i in range(200)] + [(1000 + i, "a") for i in range(500)], "doc_id long, label string")
    got = labelled_sample(docs, labels, 30, 100).collect()
    assert sorted((label, sum(r.label == label for r in got)) for label in {r.label for r in got}) == [("a", 30), ("b", 20)]
    assert all(len(r.text) <= 100 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, labelled_sample(docs.repartition(7), labels.repartition(3), 30, 100).collect()))
    long_only = labels.where("label = 'b' and doc_id % 2 = 1").union(spark.createDataFrame([(0, "a")], labels.schema))
    assert {r.label for r in labelled_sample(docs, long_only, 30, 1000).collect()} == {"a", "b"}
