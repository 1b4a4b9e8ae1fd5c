from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, lid string, size string, kept string, __t string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source), with further columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return build


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows=(): spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty, blank, very long and repeated rows."""
    return make([(1, None), (2, ""), (3, " \n\t "), (4, "word " * 40_000), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (6, "é" * 30_000), (7, "one\ntwo\n\nthree", None)])
