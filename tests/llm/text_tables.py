import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)``, with a clashing extra column."""
    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2:]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x") for i, t, lang, s in full],
                                     "doc_id bigint, text string, lang string, source string, n_chars bigint, line string")
    return make
