"""Every SQL-checkable query against its DuckDB oracle (sf0.001), as the
correctness gate does at sf0.01."""

import pytest

from conftest import SF_SMALL
from oracle_check import compare, duck
from tailorspark.plans.registry import all_oracle_sql, all_queries

SQL = all_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    msg = compare(spark, con, name, all_queries()[name], SQL[name], SF_SMALL)
    assert " OK " in msg, msg


def test_every_query_has_schema(spark):
    qs = all_queries()
    assert len(qs) >= 70
    for name in ("personalize_cold", "coldstart_table", "training_frame"):
        assert qs[name](spark, SF_SMALL).columns
