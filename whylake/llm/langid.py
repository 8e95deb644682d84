"""Language identification with a string kernel.

Two texts are as alike as the character n-grams (one to three letters) that both hold: the blended-spectrum presence
kernel, normalised to 1 for equal sets.  A bounded sample of documents with a known language is compared with landmarks
drawn from it; the Nyström map makes features of these likenesses, and one-versus-rest kernel ridge regression gives a
weight for each landmark and language.  Documents are scored in batches by two matrix products: presence with landmarks,
likenesses with weights.

Cases: a null text, or one without a letter, is ``und`` with score 0, as is everything if no language can be learned; with
one learned language all texts with letters get it; repeated rows are scored each; an empty table gives no rows; extra
columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whylake.llm.common import fresh, labelled_sample, remainder, table
from whylake.llm.words import slices

#: Bounds of the sample that is learned from: documents of each language, and characters of each.
PER_LANGUAGE, MOST_CHARS = 400, 50_000
LANDMARKS, WIDTH, LONGEST, RIDGE = 128, 1 << 14, 3, 0.1
UNKNOWN = "und"
#: Texts in one matrix product, and characters read at once.
BATCH, STRETCH = 128, 1 << 20


@cache
def folded() -> np.ndarray:
    """For every code point: the lower-case letter, or a blank where it is no letter."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def presence(text: str, out: np.ndarray) -> bool:
    """Mark the n-grams of a whole text in a row of bytes; tells whether the text has a letter."""
    found = False
    tail = np.full(1, 32, np.uint32)
    for lo in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[lo : lo + STRETCH].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.concatenate([tail, folded()[codes], [32] if lo + STRETCH >= len(text) else []]).astype(np.uint32)
        found = found or bool((codes != 32).any())
        tail = codes[-(LONGEST - 1) :]
        key = np.zeros(len(codes), np.uint32)
        for n in range(1, LONGEST + 1):
            if len(codes) < n:
                break
            key = (key[: len(codes) - n + 1] + codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            key ^= key >> np.uint32(15)
            out[key & np.uint32(WIDTH - 1)] = 1
    return found


def presences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    marks, lettered = np.zeros((len(texts), WIDTH), np.uint8), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        if t:
            lettered[i] = presence(t, marks[i])
    return marks, lettered


class KernelRidge:
    """Landmarks and their weights for each language."""

    def __init__(self, marks: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted(set(labels))
        chosen = np.random.default_rng(0).permutation(len(labels))[:landmarks]
        self.landmarks = np.packbits(marks[chosen], axis=1)
        if not self.languages:
            return
        k = self.kernel(marks)
        values, vectors = np.linalg.eigh(k[chosen])
        kept = values > 1e-6 * values.max()
        whiten = vectors[:, kept] / np.sqrt(values[kept])
        z = k @ whiten
        target = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        middle = target.mean(axis=0)
        weights = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ (target - middle))
        self.weights, self.middle = (whiten @ weights).astype(np.float32), middle.astype(np.float32)

    def kernel(self, marks: np.ndarray) -> np.ndarray:
        own = np.unpackbits(self.landmarks, axis=1, count=WIDTH).astype(np.float32)
        own /= np.sqrt(np.maximum(own.sum(axis=1, keepdims=True), 1))
        return (marks.astype(np.float32) @ own.T) / np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.float32), 1))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        marks, lettered = presences(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        scores = self.kernel(marks) @ self.weights + self.middle
        best = scores.argmax(axis=1)
        odds = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, 1 / odds.sum(axis=1), 0.0).astype(float)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> KernelRidge:
    """Fit on a bounded sample.  ``labels``: (doc_id, label).  N-gram marks are made in Spark; a few kilobytes each come back."""
    sample = labelled_sample(docs, labels, PER_LANGUAGE, MOST_CHARS, text, doc_id)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in slices(rows, 1):
                marks, lettered = presences(part.column(1).to_pylist())
                packed = pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed], names=["label", "marks"]).filter(pa.array(lettered))

    found = sorted((r.label, r.marks) for r in sample.mapInArrow(mark, "label string, marks binary").collect())
    marks = np.array([np.unpackbits(np.frombuffer(m, np.uint8)) for _, m in found], np.uint8).reshape(-1, WIDTH)
    return KernelRidge(marks, [label for label, _ in found])


def identified(docs: DataFrame, model: KernelRidge, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of every whole text and its score."""

    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            names, scores = [], []
            for lo in range(0, len(texts), BATCH):
                n, s = model.predict(texts.slice(lo, BATCH).to_pylist())
                names += n
                scores += s.tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    found = fresh(docs, "__language")
    rows = docs.withColumn(found, of(F.col(text)))
    return rows.withColumn(lang, F.col(f"{found}.lang")).withColumn(score, F.col(f"{found}.score")).drop(found)


def training_labels(docs: DataFrame) -> DataFrame:
    """Known languages of the documents that may be learned from."""
    return docs.where(remainder("doc_id", 5) != 0).select("doc_id", F.col("lang").alias("label"))


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, training_labels(docs))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
