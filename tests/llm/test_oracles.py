"""Every query with an SQL equivalent equals it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lodestone.llm import catalog
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_the_queries_are_registered():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"op1_pack", "op2_language", "op6_quality", "op11_bpe", "pipeline"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = oracle.spark_result(spark, name, SF_DIR)
    assert oracle.difference(got, oracle.sql_result(con, name)) is None
