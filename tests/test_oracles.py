"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    assert compare.difference(spark, con, name, entry.queries()[name], sql, SF) is None


def test_entry_has_rows_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "context"]
    assert df.count() == 10
