import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, token string, key string, spans string, comp int, k int, t int, b int, shard string"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text[, source]) with columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None, 7, "x", "y", "z", 1, 2, 3, 4, "s") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
