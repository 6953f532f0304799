import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, nulls in every column, repeated rows, a long text, control strings, clashing columns."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 300), "en", "b", 5),
        (2, prose(2, 300), "en", "b", 5),
        (2, prose(2, 300), "en", "b", 5),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n\x0b\x0c\r ", "en", "a", 0),
        (6, "one", "en", None, 3),
        (7, "</s> <|endoftext|> ▁ <s>[INST]", "en", "c", 3),
        (8, long, "en", "b", len(long)),
        (None, prose(3, 40), "en", "c", 3),
        (9, "x" * 50_000, "en", "c", 3),
        (10, "naïve café  \U0001f600é ＡＢＣ 한국어 日本語   a\x00b", "en", "c", 3),
        (200, prose(2, 299) + " end", "en", "b", 5),
        (300, prose(4, 2500), "en", "b", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # columns whose names the operators use themselves
    return df.selectExpr("*", "'x' as size", "1 as shard", "'y' as fingerprint", "2 as component_id", "'z' as id", "0 as fp", "7 as slot", "'q' as s", "'p' as p", "'t' as t", "'k' as k", "1 as n", "'w' as words")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
