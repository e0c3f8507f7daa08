import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, key_a string, n int"


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd(spark):
    """NULLs, empty and long texts, repeated rows, and columns named as the operators'."""
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    rows = [
        (1, None, "en", "x", 1),
        (2, "", "en", "x", 1),
        (3, " \n\t ", None, None, None),
        (4, "one two three", "de", "x", 1),
        (4, "one two three", "de", "x", 1),
        (5, long, "en", "x", 1),
        (None, "mail a.b@c.org now", "en", "x", 1),
        (7, "ünï 漢字 \U0001f600 " * 30, "fr", "x", 1),
        (8, "a" * 30_000, "en", "x", 1),
        (9, "\U0001f600\x00|#$ token = abc123xyz", None, "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
