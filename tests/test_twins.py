"""Every query with a SQL twin gives the twin's rows."""

import pytest

from lumenfold.plans import registry
from tests.twins import FOLDER, connection, rows_of, sql_rows


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    names, expected = sql_rows(con, registry.ORACLES[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, name):
    rows = registry.QUERIES[name](spark, FOLDER).collect()
    assert rows
    assert len(set(rows[0].__fields__)) == len(rows[0])
    assert sorted(map(str, registry.QUERIES[name](spark, FOLDER).collect())) == sorted(map(str, rows))  # the same again


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
