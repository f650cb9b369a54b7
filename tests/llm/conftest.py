from __future__ import annotations

import pytest

#: Columns of documents, and ones that clash with names inside the operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, digest string, _node long, stratum string, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, one id with two texts, clashing names."""
    long = "\n".join(f"word{i % 7} line{i} of a long text that goes on, and on {i}" for i in range(3000))
    rows = [
        (1, "plain words stand here for a little while and then they end.", "en", "a"),
        (1, "plain words stand here for a little while and then they end.", "en", "a"),
        (1, "another text under the same id, with some more words in it.", "en", "a"),
        (2, None, "en", None),
        (3, "", None, "a"),
        (4, " \n\t\n ", "de", "b"),
        (None, "a text without an id that still has words, twelve or so of them.", None, None),
        (5, long, "en", "a"),
        (6, "x", "en", "a"),
        (7, "write to ann@site.org or +1 (202) 555-0143 from 10.0.0.1, card 4111 1111 1111 1111", "en", "a"),
        (8, "naïve café — 日本語 😀 ▁ \x00 tail", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 9, "z", 9, "s", "k") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")
