import pytest


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """Write rows of (doc_id, text, lang, source, n_chars) and read them back, as operators get them."""

    def make(rows, name="documents", schema="doc_id long, text string, lang string, source string, n_chars long"):
        path = str(tmp_path_factory.mktemp("tables") / name)
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "!!! ### 123 \U0001f600", "en", "s", 9),
    (None, "a text without an id\nand a second line of it here", "en", "s", 1),
    (5, "same words here\nsame words here\nsame words here", "en", "s", 1),
    (6, "same words here\nsame words here\nsame words here", "en", "s", 1),
    (6, "same words here\nsame words here\nsame words here", "en", "s", 1),
    (7, "long " * 30000, "en", "s", 150000),
    (8, "x" * 5000, "en", "s", 5000),
]


@pytest.fixture(scope="session")
def odd(corpus):
    return corpus(ODD)


@pytest.fixture(scope="session")
def none(corpus):
    return corpus([])
