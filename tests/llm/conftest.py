"""Documents with everything that can go wrong, and small random corpora."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, found string, kept string, fp long, score double, doc string, key long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    texts = [
        (None, "some text without an id that goes on for a while"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"),
        (4, "another text of the same id"), (5, long), (6, long), (7, "Ünïcödé 😀 漢字 \x00 end"), (8, "!!! ??? 123"), (9, "a b c d e f g h i j k l m n o p"),
        (10, "a b c d e f g h i j k l m n o p"), (None, "a b c d e f g h i j k l m n o p"),
    ]
    return spark.createDataFrame([(i, t, "en" if i else None, None, len(t or ""), 9, "x", None, 1, None, "d", None) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(seed: int, n: int = 60, vocabulary: int = 40, words: tuple[int, int] = (0, 80)) -> list[tuple[int, str]]:
    """Texts over few words, with copied passages and whole copies."""
    draw = random.Random(seed)
    names = [f"w{k}" for k in range(vocabulary)]
    texts: list[str] = []
    for _ in range(n):
        own = [draw.choice(names) for _ in range(draw.randint(*words))]
        if texts and draw.random() < 0.6:
            other = draw.choice(texts).split()
            if other:
                at = draw.randrange(len(other))
                where = draw.randint(0, len(own))
                own[where:where] = other[at : at + draw.randint(1, 60)]
        if texts and draw.random() < 0.1:
            own = draw.choice(texts).split()
        texts.append(draw.choice([" ", "\n", "  "]).join(own))
    return list(zip(draw.sample(range(1000), n), texts))


@pytest.fixture(scope="session")
def make():
    return corpus


@pytest.fixture
def small_batches(spark):
    """Few rows per batch, so that rows meet across batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)
