import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and blank texts, one word, ties and repeated rows, a long text, other scripts.
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", "a", 5), (4, "Hello", "en", None, 5), (5, "same text here again", "en", "a", 20),
    (6, "same text here again", "en", "a", 20), (6, "same text here again", "en", "a", 20), (None, "no id at all", "en", "a", 12), (None, None, None, None, None),
    (7, LONG, "en", "a", len(LONG)), (8, "Größe – naïve 漢字 \U0001f600 test", "de", "a", 5), (9, "1234 !!! ???", None, "a", 12), (10, "a<|endoftext|>b  c\n\n d ", "en", "a", 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns under names that operators use for their own."""
    from pyspark.sql import functions as F

    names = ["fp", "key", "score", "_row", "_hashes", "_words", "spans", "kind", "batch", "n_words", "component_id", "row", "leak", "drop"]
    return odd.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


def prose(n: int, seed: int = 0, vocabulary: int = 400) -> list[str]:
    """n made-up texts with a skewed vocabulary."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(words[min(int(rng.expovariate(1 / 60)), vocabulary - 1)] for _ in range(rng.randint(20, 80))) for _ in range(n)]
