import random

import pytest

#: A table with nulls in every column, empty and blank texts, ties, repeated rows and a clashing extra column.
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "One"), (6, "one two"), (6, "one two"), (None, "one two three"), (7, "x" * 50_000), (8, "ab " * 20_000), (9, "é ü 日本 🙂 <|endoftext|>"), (10, None)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "a", None, 3) for i, t in ODD], "doc_id long, text string, lang string, id string, n long")


@pytest.fixture
def empty(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def copies():
    """Texts with a chain of near copies around a base, so that many pairs lie on either side of the limit."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    base = [word() for _ in range(120)]
    out = []
    for k in range(160):
        text = list(base)
        for _ in range(rng.randrange(0, 14)):
            text[rng.randrange(len(text))] = word()
        out.append((k * 3 + 1, " ".join(text)))
    for k in range(80):
        out.append((1000 + k, " ".join([word() for _ in range(60)] + base[:60])))
    out += [(2000 + k, " ".join(base)) for k in range(30)]
    rng.shuffle(out)
    return out
