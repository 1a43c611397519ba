import pytest

from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        *(T.StructField(c, T.StringType()) for c in ("id", "key", "row", "whole", "block", "size", "h", "doc", "score", "words", "set", "root", "hash", "pos")),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from ``(doc_id, text)`` rows, with extra columns under clashing names."""

    def build(rows, partitions=3):
        full = [(i, t, None, None, None if t is None else len(t), *("x" for _ in range(14))) for i, t in rows]
        return spark.createDataFrame(full, DOC).repartition(partitions)

    return build
