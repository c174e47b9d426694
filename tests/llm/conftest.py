import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, topic int, score double, item_id long, shard string, gone long"


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, and columns whose names clash with
    those that the operators add."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 200) for _ in range(60))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "ok", "en", "a", 2), (5, long, "de", "b", len(long)), (6, long, "de", "b", len(long)),
        (7, "é中文🎉 <|endoftext|> x", "fr", "b", 20), (7, "é中文🎉 <|endoftext|> x", "fr", "b", 20), (None, "no id here at all", "en", None, 17), (None, None, None, None, None), (8, "a b c", None, "a", 5), (9, "A\tB\x0bC", "en", "a", 5),
    ]
    return spark.createDataFrame([(*r, 1, 2, 0.5, 3, "s", 4) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false").coalesce(1)
