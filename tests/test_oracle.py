"""Every query with SQL against DuckDB on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
# the same code is compared row by row against a brute-force replay in test_windows
SLOW = {"stream_frame_windows", "stream_multitarget", "stream_changes"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_against_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note
