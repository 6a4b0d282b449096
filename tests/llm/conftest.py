import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, _op_row long, cls string, part int, mix_copy int, law string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text[, lang[, source]]), with extra columns whose names clash with inner ones."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), 0.5, 7, "c", 1, 9, "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
