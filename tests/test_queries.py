"""Every registered query against its check SQL."""

import pytest
from compare import compare, connect
from conftest import SF_DIR

from __spark_entry__ import entry, oracle_sql
from shelfwise.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_check(spark, con, name):
    assert name in oracle_sql()
    diff, _, _ = compare(spark, con, SF_DIR, name)
    assert diff is None, diff


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["ordinal", "site_ordinal", "site_name", "site_url", "score", "band"]
    assert df.count() > 0
