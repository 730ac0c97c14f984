from datetime import date, datetime

import pytest
from acctpulse import functions as fn


def one(rows, schema, values, column):
    return rows(schema, values).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "a, b, months, years",
    [
        (date(2024, 1, 31), date(2024, 2, 1), 1, 0),
        (date(2024, 2, 1), date(2024, 2, 29), 0, 0),
        (date(2023, 12, 31), date(2024, 1, 1), 1, 1),
        (date(2024, 3, 1), date(2024, 1, 31), -2, 0),
    ],
)
def test_differences_count_boundaries(rows, a, b, months, years):
    df = rows("a date, b date", (a, b))
    got = df.select(fn.month_diff("a", "b"), fn.year_diff("a", "b")).first()
    assert tuple(got) == (months, years)


def test_minute_boundaries(rows):
    a, b = datetime(2024, 1, 1, 10, 0, 59), datetime(2024, 1, 1, 10, 1, 0)
    assert one(rows, "a timestamp, b timestamp", (a, b), fn.minute_diff("a", "b")) == 1
    assert one(rows, "a timestamp, b timestamp", (b, a), fn.minute_diff("a", "b")) == -1


def test_closing_weeks(rows):
    sunday, monday = date(2024, 1, 7), date(2024, 1, 8)
    df = rows("d date", (sunday,), (monday,)).select(
        fn.week_close_before("d").alias("before"), fn.week_close_after("d").alias("after")
    )
    got = [tuple(r) for r in df.collect()]
    assert got == [(sunday, sunday), (sunday, date(2024, 1, 14))]


def test_previous_month_end_clamps(rows):
    assert one(rows, "d date", (date(2024, 3, 31),), fn.previous_month_end("d")) == date(2024, 2, 29)


@pytest.mark.parametrize(
    "a, b, zero, null", [(1.0, 0.0, 0.0, None), (None, 0.0, None, None), (1.0, None, None, None), (1.0, 2.0, 0.5, 0.5)]
)
def test_divisions(rows, a, b, zero, null):
    df = rows("a double, b double", (a, b))
    assert tuple(df.select(fn.div0("a", "b"), fn.safe_div("a", "b")).first()) == (zero, null)


def test_strict_extremes_propagate_null(rows):
    df = rows("a double, b double", (1.0, None), (1.0, 2.0))
    got = df.select(fn.greatest_strict("a", "b"), fn.least_strict("a", "b")).collect()
    assert [tuple(r) for r in got] == [(None, None), (2.0, 1.0)]


def test_whole_decimals_round_half_away(rows):
    got = rows("x double", (2.5,), (-2.5,), (0.4,), (None,)).select(fn.dec0("x").alias("x")).collect()
    assert [None if r.x is None else int(r.x) for r in got] == [3, -3, 0, None]


def test_flags_and_labels(rows):
    df = rows("f boolean, s string", (True, "Unknown"), (False, None), (None, "Good"))
    got = df.select(fn.flag01("f"), fn.or_na("s", "Unknown")).collect()
    assert [tuple(r) for r in got] == [(1, "NA"), (0, "NA"), (0, "Good")]


def test_mean_of_present_scores(rows):
    df = rows("a int, b int", (1, 2), (None, 7), (None, None))
    got = [r[0] for r in df.select(fn.dec0("a").alias("a"), fn.dec0("b").alias("b")).select(fn.mean_non_null(["a", "b"])).collect()]
    assert got == [2.0, 7.0, 0.0]


@pytest.mark.parametrize(
    "x, lo, hi, direct, inverse",
    [
        (None, 0.0, 10.0, 7.0, 7.0),
        (5.0, None, 10.0, 50.0, 50.0),
        (0.0, 0.0, 10.0, 0.0, 100.0),
        (10.0, 0.0, 10.0, 100.0, 0.0),
        (4.0, 0.0, 10.0, 40.0, 60.0),
        (5.0, 5.0, 5.0, 0.0, 100.0),
        (-9.0, 0.0, 10.0, 0.0, 100.0),
        (99.0, 0.0, 10.0, 100.0, 0.0),
    ],
)
def test_percentile_score(rows, x, lo, hi, direct, inverse):
    df = rows("x double, lo double, hi double", (x, lo, hi))
    got = df.select(
        fn.percentile_score("x", "lo", "hi", if_null=7),
        fn.percentile_score("x", "lo", "hi", if_null=7, inverse=True),
    ).first()
    assert tuple(got) == (direct, inverse)


def test_missing_value_may_stay_missing(rows):
    df = rows("x double, lo double, hi double", (None, 0.0, 1.0))
    assert df.select(fn.percentile_score("x", "lo", "hi", if_null=None)).first()[0] is None


def test_zero_if_null(rows):
    assert rows("x int", (None,)).select(fn.zero_if_null("x")).first()[0] == 0
