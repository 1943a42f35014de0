from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, fp string, part string, _spans string, _fp int"


def rows_of(texts):
    return [(i, t, "en", "s", len(t or ""), "x", "y", "z", i) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, other columns whose names operators might use."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(40)]
    long = " ".join(rng.choices(words, k=60_000))
    rows = rows_of([*texts, None, "", "   \n", long, "ÄÖ ñandú \U0001f600 é", "token = 'abc' password: secret: abcdefghijkl0123 ok"])
    rows += [rows[0], rows[0], (900, texts[0], None, None, None, None, None, None, None), (None, texts[1], "en", "s", 3, "x", "y", "z", 1), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
