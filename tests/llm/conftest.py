import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, row long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names the operators use."""
    long_text = "the shea and thion " * 4000
    passage = "a passage of many words that stands in two documents and is longer than fifty bytes"
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Hello WORLD again and again"), (5, "Hello WORLD again and again"), (6, "hello world again and again"), (7, f"x {passage} y"), (8, f"{passage} and more of it here"), (9, long_text), (10, "a" * 3000), (None, "no id but text with mail a.b@mail.example.com"), (None, None), (11, "née über ñandú 1.2.3.4 4111 1111 1111 1111 +1 (234) 555-6789 x@y.z"), (12, "\n".join(["same line here"] * 6))]
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 4 else None, None, 0.5, 1, 2) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (5, 0, 0), (6, 1, 0), (99, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
