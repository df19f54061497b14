import pytest

LONG = "".join("abcdefghij"[(i * i + i // 7) % 10] for i in range(150_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the  quick brown\nfox jumps over the lazy dog", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \t\n ", "de", "b"),
    (6, LONG, "en", "a"),
    (7, "All rights reserved. CC BY 4.0, ALL RIGHTS RESERVED", "en", None),
    (7, "All rights reserved. CC BY 4.0, ALL RIGHTS RESERVED", "en", None),
    (None, "the quick brown fox jumps over the lazy dog", None, "a"),
    (8, "naïve café 日本語 😀 ▁x  y", "fr", "b"),
    (11, "½ ² ٣ 7 _", "en", "c"),
    (9, "der schnelle braune Fuchs " * 9, "de", "c"),
    (10, "the quick brown fox\n\n\x00 weird \x1f text " + "word " * 3000, "en", "c"),
]
CLASH = ["key", "digest", "kept", "score", "bucket", "ends", "hits", "done", "ids", "row", "first", "n_words", "shard", "place"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    from pyspark.sql import functions as F

    from lorelake.llm.common import prepare

    prepare(spark)
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
