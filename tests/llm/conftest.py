import pytest

DOCS = "doc_id bigint, text string, source string"

ODD = [
    (None, "nobody's text", "s1"),
    (1, None, None),
    (2, "", "s1"),
    (3, " \t\n ", "s2"),
    (4, "Straße 漢字 🤣 naïve café ▁ <s> \x00 x", "s3"),
    (5, "the cat sat " * 2_000, "s1"),
    (6, "the cat sat " * 2_000, "s2"),
    (7, "x" * 30_000, "s1"),
    (8, "plain words and more plain words, nothing else.", "s2"),
    (8, "plain words and more plain words, nothing else.", "s2"),
]


@pytest.fixture
def odd(spark):
    """Nulls, blanks, odd letters, long texts, repeated rows, and columns whose names operators use."""
    rows = [(*r, 0, "c", "k") for r in ODD]
    schema = DOCS + ", n_tokens int, text_key string, _row string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
