"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

ORACLES = oracle_sql()
TRAINED = {n for n in queries() if n not in ORACLES}


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["pid_1", "pid_2", "occurrence_ct"]
    assert df.count() == 89


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    assert compare(spark, small, queries()[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(TRAINED))
def test_trained_queries_give_rows(spark, small, name):
    assert queries()[name](spark, small).count() > 0
