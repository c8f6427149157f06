"""Every query of the catalogue runs, and equals its reference SQL where there is one."""

import pytest
from compare import assert_same, connect

import fieldlark.queries_io  # noqa: F401  registers its queries
from fieldlark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert_same(df, con, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(ORACLES) <= set(entry.oracle_sql())
