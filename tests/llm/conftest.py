import pytest

EXTRA = ("score", "fingerprint", "component_id", "text_key", "rank", "hash", "key", "n_words", "places", "label", "length", "_key", "_doc_id", "best")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    from pyspark.sql import functions as F

    prose = "The quick brown fox jumps over the lazy dog. It was not amused by this at all! Then they went home together, as foxes and dogs sometimes do. "
    rows = [(1, prose), (2, ""), (3, None), (None, prose), (None, None), (4, prose), (4, prose), (4, "Another text under one id."), (5, "word " * 60000), (6, " \t\n "), (7, "!!! ??? 123"), (8, "é́ 日本語 \U0001f600 \x00 tail"), (9, "x" * 200000)]
    docs = spark.createDataFrame([(i, t, "en" if i else None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def none(edge):
    return edge.filter("false")
