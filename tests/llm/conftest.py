import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, kept boolean, row long, `group` string"


def make(spark, rows):
    """Documents from (doc_id, text, lang, source), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, 7, False, 7, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) + str(rng.randrange(400)) for _ in range(6000))
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for i in range(60)]
    rows += [(100, None, "en", "s1"), (101, "", "en", "s1"), (102, " \t\n", None, None), (103, long, "en", "s2"), (104, long + " end", "en", "s2"), (None, "no id here", "en", "s1"), (None, None, None, None)]
    rows += [(105, "same text again", "en", "s3")] * 3 + [(106, "sametext again", "en", "s3"), (107, "same  text again", "de", "s1"), (108, "12 34 !!", "en", "s1")]
    return make(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])
