import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "The quick  brown\tfox jumps over the lazy dog", "en", "a", 44),
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (5, " \n\t ", "de", None, 4),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG + " end", "en", "c", len(LONG) + 4),
    (8, "é ü 中文 🙂 1d10t", "fr", "ü", 15),
    (8, "é ü 中文 🙂 1d10t", "fr", "ü", 15),
    (8, "same id, another text", "fr", "ü", 21),
    (None, "no id at all", "fr", "c", 12),
    (None, "no id at all", "fr", "c", 12),
    (9, "x" * 1000, "en", "c", 1000),
    (10, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG", "en", "a", 43),
]
CLASHING = ["id", "row", "size", "score", "kept", "fp", "key", "shard", "slot", "rid", "q", "copies", "target", "part", "file", "value", "mask", "count"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, long texts, repeated rows and ids, and columns with the names that operators use."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.select("*", *[F.lit(f"own {name}").alias(name) for name in CLASHING]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
