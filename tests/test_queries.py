"""Every registered query of the library against its SQL twin."""

import pytest

from coppice import registry

from same import assert_same, sql_rows


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert len(got.columns)
    if name in registry.oracle_sql():
        assert_same(got, sql_rows(sf_dir, registry.oracle_sql()[name]))


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
