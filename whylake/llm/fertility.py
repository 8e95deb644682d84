"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback encodes every word by itself.  A text's characters per token, its share of tokens
that are single bytes, and the entropy of its tokens (relative to the most that so many tokens can have) tell how well
the vocabulary knows it.  Each writing system and language has its own bands: the quartiles over all of its documents,
widened by a multiple of their distance.  Texts outside are rejected, and so are those that fail two base rules: under 50
words, or more than half of the words in repeated windows of three.

Cases: a null text has no words; texts under the least number of words fail the base rules and do not move the bands; a
group with one document has bands that hold it; a null language is a group of its own; repeated rows are judged each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whylake.llm.common import if_small, materialise, table
from whylake.llm.words import Remembered, WordTable, codes, ragged, slices

LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
#: Widths of the bands below and above the median in distances between quartiles, and the least width.
SPREAD = (4.5, 6.0)
LEAST_WIDTH = {"chars_per_token": 0.1, "byte_share": 0.05, "token_entropy": 0.1}

# First and last code point of the writing systems told apart.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Thai": [(0xE00, 0xE7F)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
NAMES = [*SCRIPTS, "Other", "None"]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def script_of(word: str) -> int:
    """Number of the writing system of a word's first letter."""
    for c in word:
        if c.isalpha():
            for n, ranges in enumerate(SCRIPTS.values()):
                if any(lo <= ord(c) <= hi for lo, hi in ranges):
                    return n
            return NAMES.index("Other")
    return NAMES.index("None")


@cache
def encoder(path: str) -> tuple[Remembered, np.ndarray]:
    """Ids and writing system of words, and which ids are single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def compute(words: list[str]) -> list[tuple[bytes, int]]:
        return [(np.array(ids, "<u2").tobytes(), script_of(w)) for w, ids in zip(words, model.encode(words, num_threads=1), strict=True)]

    if model.get_piece_size() > 1 << 16:
        raise ValueError("ids are kept in two bytes")
    return Remembered(compute), np.array([model.is_byte(i) or model.is_unknown(i) for i in range(model.get_piece_size())])


def measured(texts: pa.Array, path: str) -> dict[str, np.ndarray]:
    """All measures of a batch of texts, null counted as empty."""
    texts = pc.fill_null(texts, "")
    values_of, is_byte = encoder(path)
    words = WordTable(texts)
    n = words.docs
    values = values_of(words.words)
    sizes = np.fromiter((len(v[0]) for v in values), np.int64, len(values)) // 2
    flat = np.frombuffer(b"".join(v[0] for v in values), "<u2")
    chars = np.asarray(pc.utf8_length(pa.array(words.words, pa.string())), dtype=np.int64)
    out = {"n_words": np.bincount(words.doc, minlength=n), "word_chars": words.total(chars)}
    out["n_symbols"] = np.asarray(pc.count_substring_regex(texts, SYMBOLS), dtype=np.int64)

    lines = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lines)))
    coded = lines.flatten().dictionary_encode()
    with_word = np.asarray(pc.match_substring_regex(coded.dictionary, "[^ \t\n\x0b\x0c\r]"), dtype=bool)
    line = coded.indices.to_numpy().astype(np.int64)
    real = with_word[line] if len(line) else np.zeros(0, bool)
    line_doc, line = line_doc[real], line[real]
    once = np.unique(codes(line_doc, line), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[once], minlength=n)

    place, doc = words.place, words.doc
    whole = np.flatnonzero(doc[: 1 - WINDOW] == doc[WINDOW - 1 :]) if len(doc) >= WINDOW else np.zeros(0, np.int64)
    inverse, counts = np.unique(codes(doc[whole], *(place[whole + i] for i in range(WINDOW))), return_inverse=True, return_counts=True)[1:]
    again = whole[counts[inverse] > 1]
    covered = np.zeros(len(doc), bool)
    for i in range(WINDOW):
        covered[again + i] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)

    ids = ragged(sizes, flat, place)
    token_doc = np.repeat(doc, sizes[place])
    tokens = np.bincount(token_doc, minlength=n)
    out["n_tokens"] = tokens
    out["chars_per_token"] = out["word_chars"] / np.maximum(tokens, 1)
    out["byte_share"] = np.bincount(token_doc[is_byte[ids]], minlength=n) / np.maximum(tokens, 1)
    each, times = np.unique(codes(token_doc, ids.astype(np.int64)), return_counts=True)
    owner = each // (int(ids.max(initial=0)) + 1)
    plogp = np.bincount(owner, weights=times * np.log(times), minlength=n)
    entropy = np.log(np.maximum(tokens, 1)) - plogp / np.maximum(tokens, 1)
    out["token_entropy"] = np.maximum(entropy, 0) / np.log(np.maximum(tokens, 2))

    script = np.fromiter((v[1] for v in values), np.int64, len(values))
    letters = np.bincount(doc * len(NAMES) + script[place], weights=chars[place], minlength=n * len(NAMES)).reshape(n, len(NAMES))
    letters[:, NAMES.index("None")] = 0.5  # only where no word has a letter
    out["script"] = np.array(NAMES)[letters.argmax(axis=1)]
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]
MEASURES = ["chars_per_token", "byte_share", "token_entropy"]


def measures(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", lang: str | None = "lang") -> DataFrame:
    """(doc_id, lang, script, counts and measures) of every whole text."""
    path = path or vocabulary()
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("lang", T.StringType()), T.StructField("script", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in MEASURES])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                found = measured(batch.column(2), path)
                columns = [pa.array(found["script"], pa.string()), *(pa.array(found[c].astype(np.int64)) for c in COUNTS), *(pa.array(found[c].astype(float)) for c in MEASURES)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.fieldNames())

    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    return docs.select(F.col(doc_id).alias("doc_id"), language.alias("lang"), F.col(text).alias("text")).mapInArrow(of, schema)


def judged(found: DataFrame, spread: tuple[float, float] = SPREAD) -> DataFrame:
    """Add base_failed, the reason of a rejection, and kept.  ``found`` is read twice: pass a written table."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = found.withColumn("base_failed", failed).withColumn("lang", F.coalesce("lang", F.lit("")))
    quartiles = found.where("not base_failed").groupBy("script", "lang").agg(
        *(F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(f"q_{c}") for c in MEASURES))
    bands = quartiles.select("script", "lang", *(
        e for c in MEASURES for e in (
            (F.col(f"q_{c}")[1] - width(c, spread[0])).alias(f"low_{c}"), (F.col(f"q_{c}")[1] + width(c, spread[1])).alias(f"high_{c}"))))
    joined = found.join(if_small(materialise(bands)), ["script", "lang"], "left")
    reason = F.when(F.col("base_failed"), "base")
    for c in MEASURES:
        reason = reason.when(F.col(c) < F.col(f"low_{c}"), f"low {c}") if c != "byte_share" else reason
        reason = reason.when(F.col(c) > F.col(f"high_{c}"), f"high {c}")
    return joined.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop(
        *(f"{side}_{c}" for side in ("low", "high") for c in MEASURES))


def width(measure: str, spread: float) -> Column:
    q = F.col(f"q_{measure}")
    return F.greatest(spread * (q[2] - q[0]), F.lit(LEAST_WIDTH[measure]))


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(measures(table(spark, sf_dir, "documents")))
    return judged(found).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                "script", "chars_per_token", "byte_share", "token_entropy", "reason")
