import pytest

import __spark_entry__ as entry
from seqspark.plans import oracles, queries
from tests.oracle import connect, same

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    same(queries.QUERIES[name](spark, SF_DIR), con, oracles.ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
    assert set(queries.QUERIES) <= set(entry.queries()) and set(oracles.ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_hot_keys_are_not_sorted_by_one_task(spark):
    plan = queries.first_ids(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
