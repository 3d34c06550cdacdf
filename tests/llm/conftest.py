"""Fixtures shared by the tests of the training-data operators (the session comes from tests/conftest.py)."""

import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside must not disturb them
    T.StructField("_row", T.StringType()), T.StructField("key", T.StringType()), T.StructField("size", T.StringType())])


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with extra columns of clashing names."""

    def make(rows, partitions=3):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *[None] * (4 - len(row)))
            full.append((doc_id, text, lang, source, None if text is None else len(text), "r", "k", "s"))
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(partitions)

    return make
