import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_crc string, rep long, n long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use themselves."""

    def docs(texts, first=0):
        rows = [(first + i, t, "en", "s", len(t or ""), "x", 7, 9) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return docs


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank, one word, very long, repeated and non-Latin texts."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    some = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    return [None, "", " \t\n", "word", "two words", long, long + " end", *some, *some[:2], some[0] + " tail", "日本語 Ünïcode \U0001f600 ß", "a  b   c d", "1234567890 " * 90]
