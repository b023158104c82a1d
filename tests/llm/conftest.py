import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""
    long_text = "alpha beta gamma delta " * 6000
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, "One two three four five six.", "en", "a", 1),
        (4, "one TWO three four five six.", "en", "a", 1),
        (4, "one TWO three four five six.", "en", "a", 1),
        (5, "x", None, "b", 1),
        (6, long_text, "en", "b", 1),
        (7, long_text + "end", "en", "b", 1),
        (None, "no id here at all today", "en", None, 1),
        (8, "1234 5678 !!", "en", "b", 1),
        (9, "ümlaut İstanbul ﬁ 漢字 \U0001f600 é é", "de", "b", 1),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    names = ("kept", "component_id", "n", "h", "t", "w", "v", "score", "shard", "slot", "rank", "__x", "a.b", "ids", "position")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)]).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
