import pytest

import __spark_entry__
from ammolite.plans.catalog import ORACLE_SQL, QUERIES

from .oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
