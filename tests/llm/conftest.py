import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(rows, extra=False):
        """rows: texts, or (doc_id, text) or (doc_id, text, source)."""
        full = []
        for k, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (k, r)
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")))
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:  # names that the operators use themselves
            df = df.selectExpr("*", "1 as size", "2 as key", "'x' as label", "3 as row", "4 as bucket", "5 as score", "6 as component", "7 as part")
        return df

    return make
