import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, cell string"


@pytest.fixture()
def docs_of(spark):
    """Documents from texts, with ids from 0 and columns whose names the operators use inside."""

    def make(texts, langs=None, sources=None):
        rows = [
            (i, t, (langs or {}).get(i), (sources or {}).get(i, "s"), None if t is None else len(t), "x", "y")
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOCS)

    return make
