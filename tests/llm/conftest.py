import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["er", "th", "on", "an", "tion", "ing", "ou", "re", "st", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def near_copy(rng, text, rate=0.04):
    return " ".join(prose(rng, 1) if rng.random() < rate else w for w in text.split())


@pytest.fixture(scope="session")
def rng():
    return random.Random(4)


@pytest.fixture(scope="session")
def texts():
    """Ordinary texts, exact and near copies, and the odd ones: null, empty, blank, one word, a very long text and a very long word."""
    r = random.Random(8)
    base = [prose(r, r.randint(3, 120)) for _ in range(40)]
    made = [*base, base[0], base[0], *(near_copy(r, base[1]) for _ in range(4)), base[2].upper(), None, "", "  \n\t ", "one", "one", "one two", prose(r, 30_000), "x" * 200_000, "é" * 50 + " ñandú 漢字 a b"]
    return made


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with a null id, a repeated row, two rows of one id, and null sources and languages."""
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"src{i % 4}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", "src1", len(texts[3])), rows[5], (rows[6][0], texts[9], "de", "src2", len(texts[9]))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(7).alias(c) for c in ("tokens", "shard", "block", "rep", "a", "b", "gram", "word", "n", "order", "cell", "size", "bucket", "rank", "row", "part", "quota")))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return text.lower().encode().split() if text else []
