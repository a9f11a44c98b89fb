import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docs_for_tests import DOCS, make_docs  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def by_id():
    def sorted_rows(rows):
        return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    return sorted_rows
