import random

import pytest

#: Columns beside those that operators read, with names that operators use themselves.
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size long, target string, copies int, item long, key string, row string, n_tokens long, component_id string, component long, wanted_id long, gone string, ids string, task int"


def as_docs(spark, rows):
    """(doc_id, text, source) rows with columns whose names clash."""
    extra = ("xx", 7, 7, "t", 7, 7, "k", "r", 7, "c", 7, 7, "g", "i", 7)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


def prose(rng, n, words=400):
    return " ".join(rng.choice(WORDS[:words]) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


_r = random.Random(5)
WORDS = ["".join(_r.choice(["an", "the", "or", "in", "st", "ré", "bl", "ou"]) for _ in range(_r.randint(1, 4))) for _ in range(3000)]

#: Null and blank ids, texts and sources, ties, repeated rows, one very long text.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (None, "no id here at all", "b"), (None, None, None),
    (4, "same row " * 30, "b"), (4, "same row " * 30, "b"), (5, "same row " * 30, "b"), (6, "One two", "c"), (7, "x" * 70_000, "c"),
    (8, "very long " * 60_000, "b"), (9, "naïve text with odd\x1cspaces", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return as_docs(spark, ODD).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return as_docs(spark, [])
