"""The driver's contract: names, oracles and a flagship result."""

import __spark_entry__ as entry


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
