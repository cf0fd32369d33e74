"""Every query against its SQL on the smallest tables."""

import pytest
from compare import difference

import __spark_entry__ as entry_module
from clipquarry import oracles
from clipquarry.queries import QUERIES
from clipquarry.sources import media

SQL = oracles.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    assert difference(QUERIES[name](spark, data), duck, SQL[name]) is None


def test_entry_gives_verdicts(spark):
    verdicts = {r.verdict for r in entry_module.entry(spark).collect()}
    assert "would still match" in verdicts and "likely distinct" in verdicts


def test_media_files(spark, data):
    files = {r.name: r.length for r in media.scan_media_files(spark, data).collect()}
    assert files["events.parquet"] > 0 and len(files) == 14
