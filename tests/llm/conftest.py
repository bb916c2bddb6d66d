import random

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of (doc_id, text) pairs."""

    def make(rows, extra=()):
        rows = [(i, t, "en", "src0", None if t is None else len(t), *["x" for _ in extra]) for i, t in rows]
        return spark.createDataFrame(rows, FIELDS + "".join(f", {c} string" for c in extra))

    return make


@pytest.fixture()
def prose():
    """Make texts of invented words."""
    rng = random.Random(4)
    parts = "ka lo mi ter an sud vel ora pin que dra fo".split()

    def make(n):
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))

    return make


#: Rows that every operator has to take: nulls, nothing, blanks, repeated rows, a long text, odd characters.
ODD = [(None, "a text without a key"), (90, None), (91, ""), (92, " \t\n "), (93, "same row"), (93, "same row"),
       (94, "word " * 20_000), (95, "é 中文   \x01 <|endoftext|>   ▁ #"), (96, "x" * 50_000)]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
