import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fingerprint string"


@pytest.fixture
def documents(spark):
    """Documents from (id, text) pairs, with columns whose names the operators use too."""

    def build(*rows):
        full = [(i, t, "en", None, None, "own", None) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return build


EDGES = (
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (None, "a row without an id"),
    (5, "the same text twice over and over again, long enough to be found by its fifty bytes"),
    (6, "the same text twice over and over again, long enough to be found by its fifty bytes"),
    (6, "the same text twice over and over again, long enough to be found by its fifty bytes"),
    (7, "é漢字😀 " * 400),
    (8, "x" * 60_000),
)


@pytest.fixture
def edges(documents):
    return documents(*EDGES)
