"""Every registered query against its SQL in DuckDB, or for rows where it has none."""

import oracle
import pytest

from quillframe.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf, name):
    assert oracle.compare(spark, sf, catalog.QUERIES[name], catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, sf, name):
    assert not catalog.QUERIES[name](spark, sf).isEmpty()


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
