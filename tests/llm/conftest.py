import random

import pytest

#: Rows with nulls, repeats, ties, empty texts and one very long text; columns whose names operators use inside.
EXTRA = "key long, fp long, size int, n long, kept string, w double, h int, t int, s int, text_ string, section int, copies int, place int, rank int, tail int, `range` int"


def long_text(words=60_000, seed=3):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randint(0, 9999)) for _ in range(words))


ODD = [
    (1, "The first text has some words in it, and it goes on for a while so that rules keep it.", "en", "a", 0),
    (1, "The first text has some words in it, and it goes on for a while so that rules keep it.", "en", "a", 0),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n\r\x0b ", "en", "b", 6),
    (5, "one", "en", "b", 3),
    (6, "the first TEXT has some words in it, and it goes on for a while so that rules keep it.", "en", None, 0),
    (7, "ünï cödé 日本語 \U0001f44d🏽 \x00 nul\n\nlines\n\nlines\n", "de", "é", 1),
    (None, "A row without an id has a text too, with enough words to count as one.", "en", "a", 1),
    (9, long_text(), "en", "b", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, *([None] * 16)) for r in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
