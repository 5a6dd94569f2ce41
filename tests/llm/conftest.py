import pytest

#: Rows that operators must get over: nulls, empty and very long texts, ties, repeated rows, clashing names.
LONG = "lorem ipsum dolor sit amet " * 8000
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, "one", "en", "s", 3), (5, LONG, "en", "s", len(LONG)), (6, LONG, "en", None, len(LONG)),
    (7, "the same words stand here twice over and over again", "en", "s", 51), (7, "the same words stand here twice over and over again", "en", "s", 51), (8, "The same words stand here twice over and over AGAIN", "en", "t", 51),
    (None, "a row without an id but with enough words to matter", "en", "s", 51), (None, "a row without an id but with enough words to matter", "en", "s", 51), (9, "é ß 漢字 😀 \\ ### </turn> <p>", "fr", "s", 20), (10, "x" * 50_000, "en", "s", 50_000), (11, "12345678901234567890" * 2000 + "@", "en", "s", 40_001),
]
EXTRA = ("node", "spans", "score", "id", "row", "path", "k0", "length", "piece", "cluster", "shard", "words", "base", "found", "key", "content")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(n) for n in EXTRA))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
