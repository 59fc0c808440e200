import pytest

import __spark_entry__ as entry
from conftest import rows_of
from loamgraph.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    got, want = core.QUERIES[name](spark, sf).toPandas(), duck.execute(core.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
