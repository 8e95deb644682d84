"""Toxicity from subword bags.

A word is the bag of its character n-grams, hashed to embeddings; a window of words is the average of its bags; a linear
softmax tells toxic windows from others.  Embeddings and softmax are trained jointly in numpy on a bounded sample of
labelled documents.  Labels belong to documents, while a few words decide them, so a document is the weighted average of
its windows: at first all count alike, and over the epochs more and more the worst.  A score is that of the worst window.
Misspelt words share most n-grams with the words that they stand for and land near them.

Cases: null and empty texts score 0; without any label, or with one class only, everything scores 0; repeated rows are
scored each; an empty table gives no rows; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whylake.llm.common import fresh, labelled_sample, remainder, table
from whylake.llm.words import Remembered, WordTable, slices

#: Bounds of the sample that is learned from: documents of each label, and characters of each.
PER_LABEL, MOST_CHARS = 1000, 12_000
BUCKETS, DIMENSIONS, SHORTEST, LONGEST, WINDOW = 1 << 17, 8, 3, 6, 3
EPOCHS, RATE, SHARPEST, DECAY = 60, 0.5, 6.0, 1e-4
THRESHOLD = 0.7
#: Texts read at once, in bytes, and words that a task remembers in each of two generations.
STRETCH, REMEMBERED = 1 << 20, 60_000


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words one after the other, and how many each word has (at least one)."""
    bare = [f"<{w.lower().strip('.,;:!?#*$%&|<>()[]{}-_/+=~^@')}>" for w in words]
    sizes = np.fromiter(map(len, bare), np.int64, len(bare))
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.repeat(np.arange(len(bare), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the word's end
    grams, owners = [], []
    key = np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        key = (key[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(13)
        inside = left[: len(key)] >= n
        if n < SHORTEST:
            inside &= (sizes[word[: len(key)]] == n) if n == 2 else False  # "<>" alone, where nothing else is left
        grams.append(((key[inside] + np.uint32(n)) & np.uint32(BUCKETS - 1)).astype(np.int32))
        owners.append(word[: len(key)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(grams)[order], np.bincount(owner, minlength=len(words))


class SubwordSoftmax:
    """Embeddings of n-grams and the softmax over them, both learned from labelled texts."""

    def __init__(self, texts: list[str], labels: list[int], epochs: int = EPOCHS):
        self.margin, self.bias = np.zeros(BUCKETS, np.float32), 0.0
        self.trained = len(set(labels)) == 2
        if self.trained:
            self.fit(texts, np.array(labels, float), epochs)

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int) -> None:
        words = WordTable(pa.array(texts, pa.string()))
        keep = np.bincount(words.doc, minlength=len(texts)) > 0
        grams, sizes = subwords(words.words)
        word_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rng = np.random.default_rng(0)
        embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        out = rng.normal(0, 0.1, (DIMENSIONS, 2))
        bias, seen, seen_out = np.zeros(2), np.full(BUCKETS, 1e-8), np.full(out.shape, 1e-8)
        first, last = windows(words.doc)
        doc = words.doc[first]
        # both classes weigh the same
        share = np.where(labels == 1, 0.5 / max((labels[keep] == 1).sum(), 1), 0.5 / max((labels[keep] == 0).sum(), 1)) * keep
        for epoch in range(epochs):
            sharp = SHARPEST * max(0.0, epoch / epochs - 0.1)
            turn = out[:, 1] - out[:, 0]
            word = np.bincount(word_of, weights=(embed @ turn)[grams], minlength=len(sizes)) / sizes
            running = np.concatenate([[0], np.cumsum(word[words.place])])
            score = (running[last] - running[first]) / (last - first) + bias[1] - bias[0]
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, doc, score)
            weight = np.exp(sharp * (score - top[doc]))
            weight /= np.bincount(doc, weights=weight, minlength=len(texts))[doc]
            pooled = np.bincount(doc, weights=weight * score, minlength=len(texts))
            error = (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - labels) * share
            each = error[doc] * weight / (last - first)
            steps = np.bincount(first, weights=each, minlength=len(running)) - np.bincount(last, weights=each, minlength=len(running))
            by_word = np.bincount(words.place, weights=np.cumsum(steps)[:-1], minlength=len(sizes)) / sizes
            slope = np.bincount(grams, weights=by_word[word_of], minlength=BUCKETS)  # of the margin, for each n-gram
            out_slope = embed.T @ slope
            seen += slope**2 * (turn @ turn)
            embed -= (RATE * ((slope / np.sqrt(seen))[:, None] * turn + DECAY * embed)).astype(np.float32)
            step = np.stack([-out_slope, out_slope], axis=1)
            seen_out += step**2
            out -= 0.2 * RATE * step / np.sqrt(seen_out)
            bias += RATE * np.array([error.sum(), -error.sum()])
        self.margin = (embed @ (out[:, 1] - out[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def of_words(self, words: list[str]) -> list[float]:
        out: list[float] = []
        for lo in range(0, len(words), 8192):
            grams, sizes = subwords(words[lo : lo + 8192])
            out += (np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=self.margin[grams], minlength=len(sizes)) / sizes).tolist()
        return out

    def scores(self, texts: pa.Array, remembered: Remembered) -> np.ndarray:
        words = WordTable(pc.fill_null(texts, ""))
        out = np.zeros(len(texts))
        if not self.trained or not len(words.place):
            return out
        word = np.array(remembered(words.words))[words.place]
        first, last = windows(words.doc)
        running = np.concatenate([[0], np.cumsum(word)])
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, words.doc[first], (running[last] - running[first]) / (last - first))
        found = np.isfinite(top)
        out[found] = 1 / (1 + np.exp(-np.clip(top[found] + self.bias, -30, 30)))
        return out


def windows(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every window of words, inside documents; a document shorter than a window is one itself."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.concatenate([begins[1:], [len(doc)]])
    end = np.repeat(ends, ends - begins)
    first = np.arange(len(doc))
    whole = (first + WINDOW <= end) | (first == np.repeat(begins, ends - begins))
    first = first[whole]
    return first, np.minimum(first + WINDOW, end[whole])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> SubwordSoftmax:
    """Fit on a bounded sample.  ``labels``: (doc_id, label), 1 for toxic."""
    rows = sorted((r.label, r.text) for r in labelled_sample(docs, labels, PER_LABEL, MOST_CHARS, text, doc_id).collect())
    return SubwordSoftmax([t for _, t in rows], [label for label, _ in rows])


def scored(docs: DataFrame, model: SubwordSoftmax, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""

    @F.arrow_udf("double")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        remembered = Remembered(model.of_words, REMEMBERED)
        for texts in parts:
            found = [model.scores(part.column(0), remembered) for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, STRETCH)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(score, of(F.col(text)))


def training_labels(labels: DataFrame) -> DataFrame:
    """Marks of the documents that may be learned from."""
    return labels.where(remainder("doc_id", 3) != 1).where("toxic in (0, 1)").select("doc_id", F.col("toxic").alias("label"))


def op5_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, training_labels(table(spark, sf_dir, "labels")))
    return scored(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
