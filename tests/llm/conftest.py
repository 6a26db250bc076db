import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import documents  # noqa: E402

@pytest.fixture(scope="session")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, start string, key string, row string, n string"
    rows = [(*r, "x", "x", "x", "x", "x", "x") for r in documents()]
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
