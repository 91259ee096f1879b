import os

import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

from . import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, name):
    oracle.agree(spark, catalog.QUERIES[name], catalog.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
