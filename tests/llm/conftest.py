import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, row long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with extra columns whose names may clash."""

    def make(rows, parts=3):
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), None, "x", 7) for i, t in rows], SCHEMA).repartition(parts)

    return make


ODD = [(None, None), (1, ""), (2, None), (3, " \t\n"), (4, "a"), (4, "a"), (5, "A b"), (6, "ab"), (None, "zz yy xx ww vv"), (7, "zz yy xx ww vv"), (8, "é" * 3000 + " 　 \x1c x"), (9, "w " * 30000)]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
