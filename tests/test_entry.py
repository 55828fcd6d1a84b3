"""Driver contract: entry() runs; every registered query runs at sf0.001."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 8
    assert set(df.columns) >= {"id", "priority_score"}


def test_oracle_keys_are_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF)
    df.limit(5).collect()
