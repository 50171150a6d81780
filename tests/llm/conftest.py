import json

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents of (doc_id, text) or (doc_id, text, lang), with extra columns whose names
    are those that the operators use inside."""
    def make(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0 if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F
        for name in ("n", "rep", "f1", "sha", "score", "label", "part", "rank", "keep_id", "component_id", "kept"):
            df = df.withColumn(name, F.lit(json.dumps(extra) if extra else "x"))
        return df
    return make


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
