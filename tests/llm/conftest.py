import os

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that an operator might take for its own
        T.StructField("size", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("_n", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", None, "y") for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, blanks, a very long text, ties, repeated rows."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(40_000)) + "\n" + "z" * 50_000
    return make_docs(
        [
            (1, "one two three four five six seven. "), (2, "one two three four five six seven. "),
            (2, "one two three four five six seven. "), (3, None), (4, ""), (5, " \n\t "), (6, long, None),
            (7, "ÉÀ ünï 語 ▁ x"), (-8, "one\ntwo"), (None, "one two three four five six seven. ", None), (None, None),
        ]
    )


def table(df, *columns):
    key = lambda t: tuple((v is None, str(type(v)), v) for v in t)
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=key)


__all__ = ["Row", "table"]
