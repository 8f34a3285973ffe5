import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_key` long, `n words` string, `a.b` int"


@pytest.fixture
def make(spark):
    """Documents from (id, text) or (id, text, source); three further columns have names that clash or need quoting."""
    def of(rows, source="s"):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else source, None if r[1] is None else len(r[1]), 7, "x", 1)
                for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return of
