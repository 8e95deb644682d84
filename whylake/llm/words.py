"""Word tables of Arrow batches: texts become places in a table of distinct words, so work is done once for a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Remembered:
    """Values of words, computed many at a time and kept in two generations, so that memory stays bounded."""

    def __init__(self, compute: Callable[[list[str]], list], most: int = 300_000):
        self.compute, self.most = compute, most
        self.known: dict = {}
        self.older: dict = {}

    def __call__(self, words: list[str]) -> list:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older, missing = self.known, self.older, []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    missing.append(w)
        known.update(zip(missing, self.compute(missing), strict=True))
        return [known[w] for w in words]

    def each(self, words: list[str]) -> Iterator:
        """The same for a list in which words repeat: what is known is only looked up."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        missing = set(words).difference(self.known)
        if missing:
            self(list(missing))
        return map(self.known.__getitem__, words)


class WordTable:
    """The words of a batch of texts: ``place`` of each in ``words``, and the ``doc`` that holds it."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts)
        values = split.flatten()
        doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split)))
        coded = values.dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        self.words: list[str] = coded.dictionary.to_pylist()
        if "" in self.words:  # white space at either end leaves an empty word
            real = place != self.words.index("")
            place, doc = place[real], doc[real]
        self.place, self.doc, self.docs = place, doc, len(texts)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum over each document of a value of its words."""
        return np.bincount(self.doc, weights=values[self.place], minlength=self.docs).astype(np.int64)


def ragged(sizes: np.ndarray, flat: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` (of ``sizes``) at ``index``, one after the other."""
    own = sizes[index]
    stops = np.cumsum(own)
    return flat[np.arange(stops[-1] if len(stops) else 0) + np.repeat((np.cumsum(sizes) - sizes)[index] - (stops - own), own)]


def codes(*columns: np.ndarray) -> np.ndarray:
    """One number for each distinct combination of values in the columns."""
    out = columns[0]
    for c in columns[1:]:
        wide = int(c.max(initial=0)) + 1
        if (int(out.max(initial=0)) + 1) * wide >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
        out = out * wide + c
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, so that long texts do not add up in memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield batch.slice(lo, hi - lo)
