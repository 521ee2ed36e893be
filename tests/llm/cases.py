"""Odd rows and fixtures for the tests of this folder; the session comes from the folder above."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Null, empty, one word, very long, ties and repeated rows, white space of all kinds.
HARD = [
    (1, None), (2, ""), (3, "one"), (None, "no id but five words here"), (4, "Tab\tand\x0bfeed\r\nlines \n\n end"),
    (5, "word " * 30_000), (6, "same text in two rows here now"), (6, "same text in two rows here now"),
    (7, "same text in two rows here now"), (8, "x" * 20_000), (9, "ünïcode ñandú 漢字 🙂 text with marks!?"),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) pairs as documents, with a column whose name clashes with inner ones."""

    def build(pairs):
        rows = [(i, t, "en", "s", len(t or ""), "k", 1) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", key string, n int")

    return build


@pytest.fixture(scope="session")
def hard(docs_of):
    return docs_of(HARD)


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
