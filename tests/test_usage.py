"""Usage metrics on rows that can be counted by hand."""

from datetime import date

import pytest

from acctpulse.plans import usage

AS_OF = date(2024, 3, 31)


def day(month, n):
    return date(2024, month, n)


@pytest.fixture
def facts(rows):
    schema = "date date, account_id long, capability string, tier string, user_id string, datacentre string, daily_active boolean"
    full, core = "FULL_PLATFORM", "CORE"
    # January: 40 accounts use "wide", one of them "rare" as well (2.5 per cent), two of them "some" (5 per cent).
    january = [(day(1, 5), n, "wide", core, "u", "eu", True) for n in range(40)]
    return rows(
        schema,
        *january,
        *january[:1],
        (day(1, 5), 0, "rare", full, "u", "eu", True),
        (day(1, 5), 0, "some", full, "u", "us", True),
        (day(1, 6), 0, "some", full, "v", "us", False),
        (day(1, 6), 1, "some", full, "w", "us", True),
        (day(1, 6), 1, "idle", "BASIC", "w", "us", True),
        (day(2, 1), 2, "rare", full, "u", "eu", True),
        (date(2019, 1, 1), 3, "old", full, "u", "eu", True),
    )


def test_reach_and_thresholds(facts):
    reach = usage.capability_reach(facts, AS_OF)
    got = {(r.month, r.capability): (r.account_count, r.total_accounts, r.usage_percentage) for r in reach.collect()}
    assert got == {
        (day(1, 1), "wide"): (40, 40, 100.0),
        (day(1, 1), "rare"): (1, 40, 2.5),
        (day(1, 1), "some"): (2, 40, 5.0),
        (day(2, 1), "rare"): (1, 1, 100.0),
    }
    counts = {r.month: r.total_features_3_percent for r in usage.capability_threshold(reach).collect()}
    assert counts == {day(1, 1): 2, day(2, 1): 1}


def test_daily_usage(facts, rows):
    flags = rows(
        "date date, account_id long, paid_account_flag boolean, paid_user_eligible boolean",
        (day(1, 5), 0, True, True),
        (day(1, 5), 1, True, False),
        (day(1, 5), 2, False, True),
        (day(1, 6), 1, True, None),
        (day(2, 1), 2, True, False),
    )
    metrics = rows("date date, account_id long, qbp_eligible boolean", (day(1, 6), 1, True), (day(2, 1), 2, False))
    daily = usage.daily_active_usage(facts, flags, metrics, AS_OF)
    got = {(r.date, r.account_id): (r.dau_actuals, r.used_features_3_percent) for r in daily.collect()}
    # Account 0: users u in eu and in us; "rare" is below the threshold. Account 1 is eligible on the second day only.
    assert got == {(day(1, 5), 0): (2, 2), (day(1, 6), 1): (1, 1)}


def test_stickiness_and_utilization(rows):
    panel = rows("account_id long, report_dt date, acr double", *[(1, day(1, n), 1.0) for n in range(1, 11)])
    daily = rows(
        "date date, account_id long, month date, dau_actuals long, used_features_3_percent long",
        (day(1, 1), 1, day(1, 1), 10, 4),
        (day(1, 10), 1, day(1, 1), 14, 2),
    )
    thresholds = rows("month date, total_features_3_percent long", (day(1, 1), 4))
    got = {r.report_dt.day: r for r in usage.stickiness_utilization(panel, daily, thresholds, AS_OF).collect()}
    assert (got[1].dau_r7d, got[1].dau_r30d, got[1].user_stickiness_ratio, got[1].product_utilization_rate) == (10, 10, 100, 100)
    # Seven rows: 14 / 7 = 2; all ten: 24 / 10 = 2.4.
    assert (got[10].dau_r7d, got[10].dau_r30d) == (2.0, 2.4)
    assert got[10].user_stickiness_ratio == pytest.approx(200 / 2.4)
    assert got[10].product_utilization_rate == pytest.approx(2 / 7 * 100 / 4)
    # Days without usage count as zero users.
    assert (got[9].dau_r7d, got[9].user_stickiness_ratio) == (0.0, 0.0)


def test_product_stickiness(rows):
    flags = rows(
        "account_id long, month date, a int, b int, c int",
        (1, day(1, 1), 1, 0, None),
        (1, day(1, 1), 1, 0, None),
        (1, day(2, 1), 1, 1, 1),
        (2, day(1, 1), None, None, None),
    )
    got = {(r[0], r[1]): tuple(r)[2:] for r in usage.product_stickiness(flags, ["a", "b", "c"], AS_OF).collect()}
    assert got == {(1, day(1, 1)): (1, 2, 50.0), (1, day(2, 1)): (3, 3, 100.0)}


def test_daily_usage_of_a_dealt_table_is_the_same(rows):
    schema = "date date, account_id long, capability string, tier string, user_id string, datacentre string, daily_active boolean"
    day = date(2001, 7, 3)
    facts = rows(
        schema,
        *[(day, a, f"c{n}", "CORE", f"u{n % 2}", "us", n != 2) for a in (1, 2, None) for n in range(4)],
        (day, 1, None, "CORE", "u9", "eu", True),
        (day, 2, "c0", "CORE", None, "eu", True),
        (day, 2, "c0", "CORE", "u0", "us", True),
        (None, 2, "c0", "CORE", "u0", "us", True),
    )
    flags = rows("date date, account_id long, paid_account_flag boolean, paid_user_eligible boolean", (day, 1, True, True), (day, 2, True, True))
    metrics = rows("date date, account_id long, qbp_eligible boolean", (day, 1, False))
    plain, dealt = (usage.capability_reach(facts, date(2001, 8, 1), dealt=d) for d in (False, True))
    assert plain.columns == dealt.columns
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, plain.collect()), key=order) == sorted(map(tuple, dealt.collect()), key=order) != []
    plain, dealt = (usage.daily_active_usage(facts, flags, metrics, date(2001, 8, 1), dealt=d) for d in (False, True))
    assert plain.columns == dealt.columns
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect())) != []
