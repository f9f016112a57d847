import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def odd_rows():
    """Nulls, empty and white texts, short ones, copies, near copies, ties, a long one, odd white space."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(n))
    base = words(60)
    near = base.split(" ")
    near[30] = "changed"
    texts = [None, "", " \n\t ", "one", "One", "two words", "a b c d e", "A B C D e f", base, base, base.upper(), " ".join(near), base + " " + words(3), words(400), words(12) + "\n" + words(9) + "\n" + words(12) + "\n",
             "don't stop  here   x  \r\n y\u0085z ", "日本語 テキスト 12345 😀 <|endoftext|> a'll", "same line\nsame line\nother\nsame line", ("x y z w v u t s " * 6).strip(), "no\ttab  double  space "]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    return [*rows, (5, "two words", "s2"), (5, "two words", "s2"), (None, base, "s1"), (None, None, None), (100, words(20_000), "s0")]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with further columns named like working columns of operators."""
    rows = [(i, t, s, None, "k", 1.5, 7, "h") for i, t, s in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string, key string, n double, bucket int, cls string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
