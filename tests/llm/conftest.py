import pytest

from tests.conftest import SF_SMALL


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


#: Rows that every operator on documents must take: nulls everywhere, empty, blank, repeated, long.
ODD = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, " \t\n", "en", "b", 3), (None, "some words here", "en", "a", 15),
       (4, "same text twice here", "en", "a", 20), (4, "same text twice here", "en", "a", 20), (5, "same  text twice here", "en", "b", 21),
       (6, "word " * 20000, "en", "a", 100000), (7, "x" * 60000, "en", "a", 60000), (-8, "naïve café 東京 🙂 \\ <s>", "fr", "é", 22)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA)
    # Extra columns whose names the operators use themselves.
    for name in ("fp", "size", "part", "key", "block", "kept", "score", "copies", "sequence_id", "norm", "hash"):
        rows = rows.withColumn(name, F.lit("extra"))
    return rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
