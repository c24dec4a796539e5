import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, shard int, score double, keys string, node long, label string, words string, removed string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and repeated rows, empty, blank and very long texts, and columns named like the operators' own."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
    long = " ".join(words[i * 7 % 20] + str(i % 97) for i in range(30_000))
    near = " ".join(words * 4)
    texts = [(1, near), (2, near + " omega"), (3, near), (3, near), (4, None), (5, ""), (6, "  \n\t "), (7, long), (8, long + " end"), (None, near), (None, None), (9, "one two"), (10, "ONE two"), (11, "İß Σς <|endoftext|> é́")]
    return spark.createDataFrame([Row(i, t, "en", "s", len(t or ""), 5, "x", 1, 0.5, "k", 2, "l", "w", "r") for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
