import pytest
from pyspark.sql import types as T

COLUMNS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                        # names that the operators use inside themselves
                        *[T.StructField(n, T.StringType()) for n in ("row", "norm", "score", "fp", "_id", "_mark", "id", "head", "hits", "flag")]])


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text[, lang]) as documents with further, clashing columns."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", *["x"] * (len(COLUMNS) - 4)) for r in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
