import random

import pytest

TOKENIZERS = "/opt/tokenizers"
#: Names that operators might use for columns of their own.
CLASHING = ("score", "sid", "key", "n", "row", "part", "gone", "h", "spans", "__at")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_rows():
    """Ids and texts: nulls, empty and white texts, ties, repeated rows, a very long text, other scripts."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "straße", "naïve", "x1", "-", "'s", "Wörter.", "don't"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(60)
    rows = [(1, base), (2, base), (2, base), (3, base.replace("alpha", "omega", 1)), (4, None), (5, ""), (6, " \t\n "), (None, base), (None, None)]
    rows += [(7, "one two three"), (8, "ONE TWO THREE"), (9, text(30_000)), (10, "x" * 40_000), (11, "первый второй третий"), (12, "日本語の文章です"), (13, "🙂 🙂\n\n🙂")]
    return rows + [(20 + k, text(rng.randint(5, 120)) + "\n" + text(12)) for k in range(20)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns of clashing names, as two partitions."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(2, "text")
    return df.withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
