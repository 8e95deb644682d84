import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None, "", " \n\t ", "a", "É", "123 456", "\x1c\x0b mixed \r\n white\tspace  ", "中文 текст עברית 한국어",
    "same text of some words that repeats in two rows", "same text of some words that repeats in two rows", "idiot " * 3, "x" * 30_000, "word " * 20_000,
    "| bars | and < marks > <|endoftext|> || a|b", "It's DON'T we'll 12a.b, (c). ", "퟿ edge \U0001f600 plane",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with everything that may go wrong, and columns that clash with names used inside."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if t is None else len(t), i, "f", "p") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[8], (None, "no id here at all", "fr", "s", 17, 1, "f", "p")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, fp string, place string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def words():
    draw = random.Random(5)
    return ["".join(draw.choice(["an", "re", "ti", "on", "ou", "st", "le", "mi"]) for _ in range(draw.randint(1, 4))) for _ in range(300)]


@pytest.fixture(scope="session")
def sf_tiny():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables not present")
    return FOLDER
