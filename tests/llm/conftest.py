"""Small tables with the awkward cases: nulls in any column, empty and long texts, ties, repeated rows, further columns with clashing names."""

import random

import pytest

WORDS = "the of an éclair ßtrasse naïve orbit lamp river stone cloud mint glass paper horse 42 x7 ñandú quiet green amber".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string, `_row` int, key string"


def prose(rnd, n):
    return "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(n)).strip()


@pytest.fixture(scope="session")
def awkward():
    """Rows of SCHEMA."""
    rnd = random.Random(7)
    shared, long = prose(rnd, 120), prose(rnd, 60_000)
    texts = [prose(rnd, rnd.randint(1, 300)) for _ in range(40)]
    texts += [None, "", " \t\n ", "a", "é", "one two three four", shared, shared, shared + " tail", "head " + shared, long, long[:-1], "=" * 3000, "ab" * 900, "\x01x\x01\ny\x01", "\n\n\n"]
    near = texts[5].split(" ")
    texts += [" ".join(near[:k] + ["changed"] + near[k + 1 :]) for k in (3, 50, 90)]
    sources = ["b", "a", "a", "a", None, "ç"]
    rows = [(i, t, rnd.choice(["en", "fr", None]), sources[i % 6], None if t is None else len(t), "q", i, None) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[1], rows[1], rows[46]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
