import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp string, key string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def odd_rows(rng):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with names used inside."""
    long = prose(rng, 30_000)
    texts = [None, "", " \t\n", "a b c", "a  b c", "A b c ", "a b c", long, long, "é日🙂 x", "a b c", None, "x@y.de +49 30 1234567", prose(rng, 80)]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 3, None, 12, None]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 2 else "s", None if t is None else len(t), k, None, "k") for k, (i, t) in enumerate(zip(ids, texts))]
    return rows + [rows[9], rows[13]]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
