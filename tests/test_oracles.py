"""Every query with SQL gives the same rows in another engine."""

import pytest

import __spark_entry__ as entry
from seqloom import queries

from .conftest import SF, canonical

CORE = {k: v for k, v in entry.oracle_sql().items() if k in queries.queries()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    found = duck.execute(CORE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, got) == canonical(columns, found.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_core_query_has_sql():
    assert set(CORE) == set(queries.queries()) <= set(entry.queries())
