import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def row(doc_id, text, lang="en", source="s"):
    return doc_id, text, lang, source, None if text is None else len(text)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    dice = random.Random(7)
    words = "the of and to in a is that it was for on are as with his they at be this".split()
    long = " ".join(dice.choice(words) + str(dice.randint(0, 99)) for _ in range(30_000))
    text = " ".join(dice.choice(words) for _ in range(60))
    return [row(1, None), row(2, ""), row(3, " \n\t "), row(4, long), row(5, text),
            row(6, text), row(6, text), row(7, text, None, None), row(None, text),
            row(None, None), row(8, "x" * 50_000), row(9, "é日本\x00\x85 ß👍🏽 ŉ"), row(10, "a b"),
            row(11, "a b"), row(12, "1234 5678"), row(13, text + " more"), (14, text, "en", "s", None)]


@pytest.fixture
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names operators use themselves."""
    return spark.createDataFrame(
        [(*r, 1, "x", 2.0, [1]) for r in odd_rows],
        SCHEMA + ", n int, row string, score double, found array<int>")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")
