"""Small tables with everything that the operators must bear: nulls, empty and very long texts, ties, repeated rows."""

import os
import sys

import pytest
from llm_samples import DOCUMENTS, odd_rows

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

@pytest.fixture(scope="session")
def odd(spark):
    """Documents with an extra column whose name operators use inside."""
    rows = [(*row, "kept") for row in odd_rows()]
    return spark.createDataFrame(rows, DOCUMENTS + ", size string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
