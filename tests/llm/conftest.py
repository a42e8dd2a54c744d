import pytest

from fieldpulse.llm.registry import ready

LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(autouse=True)
def settings(spark):
    ready(spark)


@pytest.fixture
def edge_rows():
    """NULLs in any column, empty and very long texts, ties, repeated rows."""
    same = (7, "the same row, here twice, with token = 'abcdef123456'", "en", "src0", 10)
    return [
        (1, None, None, None, None), (None, "no id but MIT License", None, "src0", 3), (2, "", "en", "src0", 0),
        (3, " \t\n ", "en", None, 4), (4, LONG, "en", "src0", len(LONG)), same, same,
        (8, "the same row, here twice, with token = 'abcdef123456'", "en", "src0", 10),
        (9, "ünï çödé — 日本語 текст\x00\x0b", "fr", "src1", 20), (10, "!!! ... ---", "xx", "src1", 11),
    ]


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["_id", "_gone", "_spans", "_items", "_body", "_n", "row", "copies", "_row", "_text", "blob", "n_words", "shard", "_key", "kept", "_words", "labels", "score", "spans"]


@pytest.fixture
def edge(spark, edge_rows):
    """The edge rows with further columns whose names the operators use inside."""
    df = spark.createDataFrame(edge_rows, COLUMNS)
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], COLUMNS)
