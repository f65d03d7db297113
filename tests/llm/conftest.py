import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text[, source])."""

    def make(rows, extra=()):
        schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in extra]])
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1]), *["x"] * len(extra)) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def sf():
    return SF


#: Names that operators use or might use inside.
CLASHING = ("id", "fp", "component", "label", "__row", "score", "source_1", "rate", "copy", "host", "lines", "chunk", "ids", "__copy", "__order", "__host", "__clean", "__own0", "row", "count", "order", "dotted.name")


@pytest.fixture
def clashing():
    return CLASHING
