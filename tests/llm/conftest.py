import pytest

#: Columns that operators use for themselves, as extra columns of the input.
CLASHES = "digest string, row long, fp long, h string, g long, id string, kept string, score string, p string, keep_id string, __n long"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table with null-able columns and clashing extra ones, over two partitions."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source, len(t or ""), *("x", 1, 2, "y", 3, "z", "k", "s", "p", "q", 4)) for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(2)

    return make


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


EDGES = [(1, ""), (2, None), (None, "a b"), (3, " \t\n"), (4, "a b"), (4, "a b"), (5, "word " * 5000), (6, "çé 漢字 ​ x")]
