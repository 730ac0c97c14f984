"""Registered queries against their SQL at the smallest scale.

A selection runs by default; set ACCTPULSE_ALL=1 for every query.
"""

import math
import os
import re

import pytest

import __spark_entry__ as entry
from tools.compare import key, plain

duckdb = pytest.importorskip("duckdb")

SELECTION = (
    "trailing_median user_activation product_stickiness capability_threshold stickiness_utilization term_to_date_updated "
    "financial_metrics support_metrics latest_invoice latest_weekly_score competitor_monthly account_360 metric_percentiles "
    "health_score churn_date weekly_spine lag_features family_flags weekly_flags lag_presence weekly_log_volume "
    "churn_features account_segments null_profile impute_segment_median segment_ols segment_correlation segment_vif "
    "like_filters join_computed_key join_band join_theta join_scd2 distinct_counts window_percentiles "
    "running_sum_rows unpivot_keep scalar_numeric scalar_dates"
).split()
#: The corpus operators have tests of their own, beside which they can be taken out.
ANALYSES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]
NAMES = ANALYSES if os.environ.get("ACCTPULSE_ALL") else SELECTION


@pytest.fixture(scope="module")
def con(data):
    connection = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


def same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    return x == y


def test_every_sql_has_its_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(ANALYSES) - set(sql) == {"segment_ols_metrics", "segment_vif_metrics", "rf_importance"}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, con, name):
    sql = entry.oracle_sql()
    df = entry.queries()[name](spark, data)
    ours = df.collect()
    if name not in sql:
        assert ours
        return
    result = con.execute(sql[name])
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    order = sorted(columns)
    assert order == sorted(df.columns)
    at = [columns.index(c) for c in order]
    a = sorted((tuple(plain(r[c]) for c in order) for r in ours), key=key)
    b = sorted((tuple(plain(r[p]) for p in at) for r in theirs), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(map(same, x, y)), (x, y)


def test_no_cross_product_in_the_panel(spark, data):
    df = entry.queries()["account_360"](spark, data)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


def test_the_panel_is_dealt_by_account_once(spark, data):
    df = entry.queries()["account_360"](spark, data)
    physical = df._jdf.queryExecution().executedPlan().toString()
    by_account = re.findall(r"Exchange hashpartitioning\((?:account_id|date#\d+, account_id|report_dt#\d+, account_id)#.*", physical)
    # The competitor branch and the support cases come from other keys: two regions, their months, three branches of cases.
    assert len(by_account) <= 7
    assert "Bucketed: true" in physical
