import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from texts, (doc_id, text) or (doc_id, text, source) rows,
    with extra columns whose names clash with the operators' own."""

    def build(rows, parts=3):
        out = []
        for i, row in enumerate(rows):
            row = (i, row) if row is None or isinstance(row, str) else tuple(row)
            doc_id, text, source = (*row, "s0")[:3]
            out.append((doc_id, text, "en", source, None if text is None else len(text), "x", None, 7, "k"))
        schema = SCHEMA + ", fp string, text_key string, word long, k string"
        return spark.createDataFrame(out, schema).repartition(parts)

    return build
