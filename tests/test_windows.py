import statistics
from datetime import date, timedelta

from pyspark.sql import functions as F

from acctpulse.operators.latest import latest_slice, month_end_or, newest, top_row
from acctpulse.operators.rolling import prior_avg, rolling_avg, trailing_median
from acctpulse.plans.usage import user_activation
from acctpulse.registry import AS_OF, MONTHS
from acctpulse.sources.inputs import Inputs

D = date(2024, 3, 1)


def day(n):
    return D + timedelta(days=n)


def medians(rows, *tuples):
    df = rows("account_id long, report_dt date, users double", *tuples)
    out = trailing_median(df, "account_id", "report_dt", "users", 60, "m").collect()
    return {(r.account_id, r.report_dt, r.users): r.m for r in out}


def test_median_band_includes_day_60_not_day_61(rows):
    got = medians(rows, (1, day(0), 10.0), (1, day(60), 20.0), (1, day(61), 40.0))
    assert got[(1, day(60), 20.0)] == 15.0
    assert got[(1, day(61), 40.0)] == 30.0


def test_two_counts_on_one_day_both_count(rows):
    got = medians(rows, (1, D, 5.0), (1, D, 7.0), (1, D, 7.0), (1, day(1), 9.0))
    assert got == {(1, D, 5.0): 6.0, (1, D, 7.0): 6.0, (1, day(1), 9.0): 7.0}


def test_row_without_account_has_no_median(rows):
    assert medians(rows, (None, D, 5.0)) == {(None, D, 5.0): None}


def test_median_against_brute_force_with_one_hot_account(rows):
    data = [(a, day(3 * k % 400), float(k * 7 % 11)) for a in (1, 2) for k in range(300 if a == 1 else 9)]
    got = medians(rows, *data)
    distinct = set(data)
    for (a, d, u), m in got.items():
        band = [x for (b, e, x) in distinct if b == a and 0 <= (d - e).days <= 60]
        assert m == statistics.median(band)
    assert set(got) == distinct


def test_rolling_rows_ignore_gaps(rows):
    df = rows("k long, d date, x double", (1, D, 1.0), (1, day(1), 3.0), (1, day(9), 8.0))
    out = rolling_avg(df, ["k"], "d", {"two": ("x", 2)}).orderBy("d").collect()
    assert [r.two for r in out] == [1.0, 2.0, 5.5]


def test_prior_average_excludes_current(rows):
    df = rows("k long, d date, x double", *[(1, day(n), float(n)) for n in range(5)])
    out = prior_avg(df, ["k"], "d", {"p": "x"}).orderBy("d").collect()
    assert [r.p for r in out] == [None, 0.0, 0.5, 1.0, 2.0]


def test_activation_same_with_and_without_grain_shortcut(spark, data):
    panel = Inputs(spark, data).account_daily()
    a = user_activation(panel, AS_OF, MONTHS)
    b = user_activation(panel, AS_OF, MONTHS, one_row_per_day=False).select(*a.columns)
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_horizon_is_thirty_months_from_month_start(rows):
    panel = rows(
        "account_id long, report_dt date",
        (1, date(2021, 8, 31)),
        (1, date(2021, 9, 1)),
        (1, date(2024, 3, 15)),
        (1, date(2024, 3, 16)),
    )
    from acctpulse.plans.usage import in_horizon

    kept = panel.filter(in_horizon("report_dt", date(2024, 3, 15), 30, from_month_start=True))
    assert sorted(r.report_dt for r in kept.collect()) == [date(2021, 9, 1), date(2024, 3, 15)]
    kept = panel.filter(in_horizon("report_dt", date(2024, 3, 15), 30))
    assert [r.report_dt for r in kept.collect()] == [date(2024, 3, 15)]


def test_month_end_or_newest(rows):
    df = rows("d date", (date(2024, 1, 31),), (date(2024, 2, 28),), (date(2024, 3, 5),))
    got = month_end_or(df, "d", newest(df, "d")).collect()
    assert sorted(r.d for r in got) == [date(2024, 1, 31), date(2024, 3, 5)]
    assert latest_slice(df, "d").count() == 1


def test_top_row_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = top_row(df, ["k"], [F.col("id").desc()])
    assert sorted(r.id for r in top.collect()) == [997, 998, 999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
