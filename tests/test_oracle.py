"""Every query with an oracle gives the same rows as DuckDB (smallest tables)."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.oracle_check import compare, duck

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)


# Planted transforms need more points per pair than the smallest tables have: run on the next larger ones.
TOO_SMALL = {"locked_rotations", "estimated_transforms", "scale_mismatches"}


@pytest.mark.parametrize("name", sorted(TOO_SMALL))
def test_query_on_more_points(spark, name):
    result = compare(QUERIES[name](spark, LARGER), duck(LARGER), ORACLES[name])
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TOO_SMALL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        result = compare(df, con, ORACLES[name])
        assert result.startswith("ok"), result
    else:
        assert df.count() > 0
