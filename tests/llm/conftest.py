import random

import pytest

LONG = " ".join(f"word{i % 997}" for i in range(120_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, row string, n bigint, bucket int, key string, h int, id string, items int"
WORDS = "the of and to in is that by with on for as it at from or an be this which have not are but had his they was".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "ing", "ed", "tion"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows and columns of clashing names."""
    extra = (1, "x", 2, 3, "k", 4, "i", 5)
    base = prose(1, 60)
    rows = [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (2, base, "en", "a", 10), (3, base + " more", "en", None, None), (4, None, "en", "a", 1),
        (5, "", None, "b", 0), (6, " \n\t ", "de", "b", 3), (None, base, "en", "a", 1), (None, None, None, None, None), (7, "one two", "de", "b", 7),
        (8, LONG, "en", "c", len(LONG)), (9, "ÄÖÜ ß 日本語 \U0001f600 é", "de", "c", 5), (10, "12 34 %% !!", None, None, 4), (11, prose(2, 400), "en", "a", 9),
    ]
    return spark.createDataFrame([r + extra for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
