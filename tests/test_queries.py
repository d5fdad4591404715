"""Every registered query against its SQL on the same tables."""

import compare
import pytest

from tidewell.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    columns, rows = compare.spark_rows(QUERIES[name](spark, sf_dir))
    if name not in ORACLES:
        assert rows
        return
    sql_columns, sql_rows = compare.sql_rows(duck, ORACLES[name])
    assert columns == sql_columns
    assert rows == sql_rows


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["name", "events", "users"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
