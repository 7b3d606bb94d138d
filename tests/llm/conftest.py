import pytest
from pyspark.sql import functions as F

#: Null, empty and odd texts, repeated rows, a null id, and columns whose names the operators use themselves.
ROWS = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t ", "en", None), (4, "one two", "en", "b"),
    (5, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "b"),
    (5, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "b"),
    (6, "The Quick brown FOX jumps over the lazy dog and runs away from it", "en", "a"),
    (7, "le chat dort sur la table et la souris danse dans la cuisine é à ü", "fr", "c"),
    (8, "123 456 !!! ???", "fr", "c"), (None, "no id here but some words to read", "de", "c"),
    (9, "wörter " * 30_000, "de", "c"), (10, "x" * 200_000, None, "a"), (11, "ÄÖÜ ß € 中文 😀", "de", "b"),
]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in ("score", "size", "n", "node", "key", "words", "n_chars")})


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
