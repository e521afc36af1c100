"""Every registered query with expected SQL gives exactly the rows of that SQL."""

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


# The stream takes minutes; tests/test_stream.py compares it over nine days.
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - {"stream_replay"}))
def test_matches_sql(spark, con, sf_dir, name):
    result = entry.queries()[name](spark, sf_dir)
    assert difference(result, con, entry.oracle_sql()[name]) is None


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
