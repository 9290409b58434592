from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, line string, k1 long, kept boolean"


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, one very long text, one without blanks, repeated rows and ids, near copies, odd characters."""
    rng = random.Random(5)
    base = _words(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [None, "", "  \n\t ", "one", base, base, " ".join(near), _words(rng, 30_000), "x" * 50_000, "日本語" * 400, "a\0b ▁ é\r\n" * 20, base + "\n" + _words(rng, 50)]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "s", None, "r", "l", i, None) for i, t in enumerate(texts)]
    return rows + [rows[4], (4, _words(rng, 60), "en", "s", 1, "r", "l", 1, True), (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """A table with columns whose names operators use themselves."""
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
