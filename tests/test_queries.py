"""Every query that has SQL gives the rows of its SQL; the others give rows."""

import pytest

import __spark_entry__ as entry
from factloom.plans import catalog
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE_SQL:
        assert differences(df, con, catalog.ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "spread_pct" in df.columns


def test_partitioning_does_not_change_results(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = sorted(map(str, catalog.QUERIES["W-4_anomalies"](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(str, catalog.QUERIES["W-4_anomalies"](spark, sf).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
