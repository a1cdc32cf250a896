"""Every query of the catalogue on the smallest tables, held against its SQL where it has one."""

import pytest

from newsgauge.plans import catalog

from oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], con)


def test_daily_stream_alerts_once(spark):
    rows = catalog.QUERIES["daily_stream"](spark, SF).orderBy("batch").collect()
    assert rows[0]["new_mentions"] > 0 and rows[0]["delivered"] > 0 and rows[0]["outcome"] == "sent"
    assert rows[1]["new_mentions"] == 0 and rows[1]["outcome"] == "nothing-new"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

