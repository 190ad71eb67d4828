"""Registration: one query per operator, oracles only for registered queries."""

import re

import __spark_entry__ as entry


def test_every_operator_has_one_query():
    names = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_match(spark):
    from conftest import SF_SMALL
    from oracle_check import compare, duck
    from tailorspark.llm.queries import ORACLES, QUERIES

    con = duck(SF_SMALL)
    for name, sql in ORACLES.items():
        assert " OK " in (msg := compare(spark, con, name, QUERIES[name], sql, SF_SMALL)), msg
