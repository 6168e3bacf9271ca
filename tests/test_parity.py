"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import parity

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return parity.duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    ok, note, _ = parity.compare(
        spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf
    )
    assert ok, note


def test_sql_names_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark, sf):
    assert entry.entry(spark).limit(1).count() == 1
