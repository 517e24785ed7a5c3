from __future__ import annotations

import pytest

#: One document of each kind that operators must survive.
LONG = "the quick brown fox " * 15_000
ROWS = [
    (1, "The cat sat on the mat with a hat and a bat today.", "en", "b"),
    (2, "The cat sat on the mat with a hat and a bat today.", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t ", "fr", "a"),
    (6, LONG, "en", "b"),
    (7, "été où ça naïve garçon élève", "fr", None),
    (7, "été où ça naïve garçon élève", "fr", None),
    (None, "a row without an id stays a row", None, "c"),
    (9, "1234 5678 !!! 👍", "en", "c"),
]
#: Names that operators use inside.
CLASHING = ("id", "hash", "fp", "score", "key", "size", "part", "rs_hash", "rs_same_id", "toxic", "row", "copies")


@pytest.fixture()
def hard_docs(spark):
    """documents with nulls, empty and long texts, repeats, and extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    rows = [(*r, len(r[1] or ""), *["x"] * len(CLASHING)) for r in ROWS]
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def no_docs(hard_docs):
    return hard_docs.limit(0)


@pytest.fixture()
def docs_of(spark):
    def make(texts, start=0, **more):
        rows = [(start + i, t, more.get("lang", "en"), more.get("source", "s"), len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
