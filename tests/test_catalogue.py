"""Every registered query of the engine's own operators against its SQL."""

import pytest

from blockloom import catalogue
from comparing import assert_same, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, small, con, name):
    assert_same(catalogue.QUERIES[name](spark, small), con, catalogue.ORACLES[name])


def test_stream_equals_batch(spark, small):
    batch = catalogue.QUERIES["suite_summary"](spark, small).drop("run")
    stream = catalogue.QUERIES["stream_suite_summary"](spark, small).select(*batch.columns)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
