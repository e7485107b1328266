"""Every query of the package against its DuckDB SQL on the smallest test tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from test_queries import FOLDER, compare

from quirewright.llm import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLE.get(name))
