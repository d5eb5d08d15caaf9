from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from texts (ids by position) or (doc_id, text) pairs."""
    def make(texts, extra=None):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, ("en", "fr", None)[k % 3], f"s{k % 4}", len(t or "")) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, DOCS)
    return make
