"""Documents with every awkward case: nulls, empty and very long texts, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, rid int, shard int, length string"
WORDS = "the of and erth ion tion anea here thon nd ing es or red bolt éau ñca größe wort".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", ".", ","]) + (str(rng.randint(0, 9)) if rng.random() < 0.02 else "") for _ in range(n))


def odd_rows():
    long = prose(1, 40_000)
    texts = [None, "", "   \n", "!!!", "one", "One, two.", long, prose(2, 300), prose(2, 300), prose(2, 300) + " changed", prose(3, 80), prose(3, 80).upper(), "x" * 30_000, prose(4, 5), "漢字 かな 😀 text", "a\x1cb\x00c", prose(5, 700)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 0.5, "w", 1, 2, "l") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, prose(6, 50), None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
