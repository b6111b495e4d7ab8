import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, starts string, anchor long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of pairs of id and text, with further columns whose names clash with inner ones."""

    def table(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, "x", "y", 3) for i, t in rows], SCHEMA)

    return table


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a null id, a repeated row, a very long text and other white space."""
    draw = random.Random(9)
    long = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 9))) for _ in range(20_000))
    return [(1, "One two three four five"), (1, "One two three four five"), (2, None), (3, ""), (None, "one two three four five"), (4, long), (5, "  a b \n\n c\t\tÉté "), (6, "x")]
