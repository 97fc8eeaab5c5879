import random

import pytest

from tabclean.llm import common

SPACES = [" ", "  ", "\n", "\t", " \r\n", "\x0b", "\x0c", " "]


@pytest.fixture(autouse=True)
def ready(spark):
    common.prepare(spark)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, odd characters, copies, and a very long text."""
    rnd = random.Random(3)
    words = ["the", "The", "cat", "idiot", "über", "niño", "don't", "123", "a.b", "日本", "🎉", "▁", "<s>", "<|endoftext|>", "...", "é"]
    made = ["".join(rnd.choice(words) + rnd.choice(SPACES) for _ in range(rnd.randint(1, 30))) for _ in range(40)]
    return [None, "", " ", "\n", "a", "a b c", "a  b\tc", " a b c ", "one two three four five", "One two three four five",
            *made, *made[:5], "long " * 30_000, "x" * 50_000]


@pytest.fixture()
def odd_docs(spark, odd_texts):
    """The odd texts, one row twice, with other columns of clashing names."""
    rows = [(i, t, "en" if i % 3 else None, "s", i, i, "x", 1.5) for i, t in enumerate(odd_texts)]
    rows.append(rows[7])
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _id bigint, _row bigint, kept string, score double").repartition(3)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
