import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns."""

    def build(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        return spark.createDataFrame(
            [(i, t, lang, src, len(t or ""), "x", 0) for i, t, lang, src in full],
            "doc_id long, text string, lang string, source string, n_chars long, score string, node int",
        )

    return build


#: Nulls, empty and blank texts, ties, repeated rows, odd characters, one long text.
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "a"), (3, "a"), (4, "A b"), (5, "a B"), (6, "ÄÖ ä ß 123 !!"),
    (7, "word " * 20_000), (8, "\x00\x01 zero \x1f"), (9, "日本語 テキスト"), (None, "no id at all here"), (10, "🙂 smile"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(docs_of, odd):
    return odd.where("false")
