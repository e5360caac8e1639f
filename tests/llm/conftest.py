import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves, or that other tables have.
CLASHING = ("item_id", "score", "component_id", "cluster", "token", "tokens", "size", "copies", "_key", "_n", "label", "x", "y")


def prose(seed: int, words: int) -> str:
    """Words that two seeds hardly share in sequence."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(("river", "stone", "paper", "light", "green", "house", "walks", "seven", "under", "music", "early", "train", "cloud", "glass", "north", "field")) + r.choice(("", "s", "ed", "ing")) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, copies, a repeated row, and clashing extra columns."""
    from pyspark.sql import functions as F

    long = prose(1, 60_000)
    rows = [
        (1, prose(2, 60), "en", "src1", 300), (2, prose(2, 60), "en", "src1", 300), (3, None, "en", "src1", None), (4, "", "de", "src2", 0), (5, "  \t\n ", None, None, 5),
        (6, long, "en", "src1", len(long)), (7, long + " end", "en", "src1", len(long) + 4), (8, "word", "fr", "src12", 4), (9, "word", "fr", "src12", 4),
        (10, prose(3, 40), None, "src3", 200), (10, prose(3, 40), None, "src3", 200), (None, prose(4, 50), "en", "src4", 1), (None, None, None, None, None), (11, "é ß \U0001f600 \u0000 x", "de", "src15", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("own") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
