import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def invented():
    """Makes a text of n invented words."""

    def make(n, seed, vocab=400):
        r = random.Random(seed)
        return " ".join(f"{'aeiou'[k % 5]}w{k}" for k in (int(r.paretovariate(0.6)) % vocab for _ in range(n)))

    return make
