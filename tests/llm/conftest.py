import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: the odd cases that every operator must stand: nulls, empty and long texts, repeated rows, clashing extra columns
ODD = [
    (1, "a b c d e f g h", "en", "s", 15),
    (2, "a b c d e f g h", "en", "s", 15),
    (3, "", None, None, 0),
    (4, None, "en", "s", None),
    (5, "one", "en", "s", 3),
    (5, "one", "en", "s", 3),
    (None, "no id here", "en", "s", 10),
    (7, "x\ty\n\nz  w " * 4000, "en", "s", 44000),
    (8, "çà É ß ﬁ 漢字 🙂 é", "fr", "s", 12),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with columns whose names clash with results and helpers."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("score", "length", "component_id", "shard", "ids", "n", "a", "b", "u", "v", "size", "start", "h")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
