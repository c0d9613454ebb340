import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
# worker processes import the package as well
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

EDGE_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "é日本 🙂 'll <|endoftext|> x"), (7, "### $$$ !!!"),
    (8, "same words in the same order here " * 30), (9, "same words in the same order here " * 30), (9, "same words in the same order here " * 30),
    (None, "same words in the same order here " * 30), (10, "long " * 60000), (11, "a" * 50000),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "en", "src0", len(t or ""), "k", 1, True) for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `key` string, n_words int, kept boolean")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
