from __future__ import annotations

import random

import pytest
from texts import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, __text string"


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, columns with names that operators use."""
    rng = random.Random(5)
    long = prose(rng, 20_000)
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "  \n\n ", "en", None), (4, long, "en", "b"), (5, long, None, None), (None, "some words without an id at all", "en", "a"), (6, "equal text of six words here", "en", "a"), (6, "equal text of six words here", "en", "a"), (7, "equal text of six words here", "de", "b"), (8, "12 34 !!", None, "c"), (None, None, None, None)]
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 0.5, "x", "y") for i, t, l, s in rows], SCHEMA)


@pytest.fixture
def none(odd):
    return odd.where("false")

