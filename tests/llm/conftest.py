import pytest

LONG = "ein langer Text mit Wörtern " * 6000


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, a very long one, repeated rows, a null id, other columns with names that clash."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same text here"), (5, "same text here"), (6, "same text here"), (None, "no id"), (7, "中文没有空格的文字" * 30), (8, "a" * 3000)]
    return spark.createDataFrame([(i, t, 0.5, "x", 7, [1]) for i, t in rows], "doc_id long, text string, score double, sig string, n int, found array<int>")


@pytest.fixture(scope="session")
def texts(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
