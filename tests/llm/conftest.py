import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents of (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        return docs.selectExpr("*", "1 AS class_id", "'x' AS kept", "2 AS n", "3 AS start", "4 AS bucket", "5 AS bands", "6 AS part")

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
