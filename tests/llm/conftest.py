import pytest
from llm_samples import prose
from pyspark.sql import functions as F

#: Names that the operators use inside, as extra columns of the input.
CLASH = ("__id", "__text", "__row", "__len", "__prefix", "__gone", "__old", "__new", "group_id", "is_kept", "h1", "a", "b", "blob", "n_tokens", "score", "bin", "g")


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.select("*", *[F.lit(c).alias(c) for c in CLASH]) if clash else df

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Null ids and texts, empty and blank texts, repeated rows, a very long text, ties."""
    long = prose(60_000, 1)
    rows = [(1, "alpha beta"), (1, "alpha beta"), (2, "alpha beta"), (None, "alpha beta"), (3, None), (None, None), (4, ""), (5, ""), (6, " \n\t "), (7, long), (8, long + " tail"), (9, "one"), (10, "!!! ???"), (11, "Ünïcödé 中文 🙂 it's"), (12, prose(80, 2)), (13, prose(80, 2))]
    return docs_of(rows)
