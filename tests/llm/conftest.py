import numpy as np
import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, lang, source) rows, with columns that clash with helper names."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row string, key int, lines int, fp int, score int, tokens int"
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "x", "y", 1, 2, 3, 4, 5) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def words():
    """Invented words."""
    random = np.random.default_rng(1)
    parts = ["ka", "lo", "mi", "ner", "tu", "vas", "qui", "do", "rel", "sha"]
    return ["".join(random.choice(parts, random.integers(1, 4))) for _ in range(400)]
