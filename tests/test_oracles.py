"""Every query equals its SQL equivalent on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lodestone import catalog
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(catalog.all_queries()) == set(catalog.all_oracles())


@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_query_equals_sql(spark, con, name):
    got = oracle.spark_result(spark, name, SF_DIR)
    assert oracle.difference(got, oracle.sql_result(con, name)) is None


def test_entry_is_the_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "rank", "id", "source", "text", "similarity"]
    assert rows.count() == 5 * 40
