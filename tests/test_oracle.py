"""Every registered query with a SQL twin equals DuckDB on the smallest scale."""

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_harness import compare, duck
from tessera.plans.registry import load_all

WITH_SQL = sorted(n for n, q in load_all().items() if q.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


TIME_QUERIES = ["calc_columns", "kpi_efficiency", "response_times", "late_report", "cooldown_alerts",
                "alert_digest", "timeliness", "stock_history", "parse_due_date", "trend"]


def test_time_arithmetic_ignores_session_zone(spark, con):
    """Durations and epoch arithmetic use wall-clock time: a session in a
    daylight-saving zone gives the same results as the UTC oracle."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in TIME_QUERIES:
            r = compare(spark, con, name, load_all()[name], SF_SMALL)
            assert r["status"] == "ok", r
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_oracle(spark, con, name):
    r = compare(spark, con, name, load_all()[name], SF_SMALL)
    assert r["status"] == "ok", r
    assert "types" not in r, r  # column types equal too (Spark type vs DuckDB type)
