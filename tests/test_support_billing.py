from collections import defaultdict
from datetime import date, datetime

import pytest

from acctpulse.plans import billing, support
from acctpulse.registry import AS_OF, MONTHS
from acctpulse.sources.inputs import Inputs

FLOOR = date(2023, 1, 1)
CASES = (
    "case_id long, account_id long, account_name string, priority string, created_ts timestamp,"
    " solved_ts timestamp, first_response_ts timestamp, csat double"
)


def ts(*a):
    return datetime(*a)


def test_last_priority_change_gives_its_old_value(rows):
    cases = rows(
        CASES,
        (1, 9, "n", "P3", ts(2024, 1, 2), None, None, None),
        (2, 9, "n", "P2", ts(2024, 1, 3), None, None, None),
        (3, 9, "n", None, ts(2024, 1, 3), None, None, None),
        (4, 8, "m", "P1", ts(2024, 1, 3), None, None, None),
    )
    history = rows(
        "case_id long, field string, old_value string, created_ts timestamp",
        (1, "Priority", "P4", ts(2024, 1, 4)),
        (1, "Priority", "P1", ts(2024, 1, 5)),
        (1, "Status", "P2", ts(2024, 1, 6)),
    )
    out = support.case_priority(cases, history, FLOOR).collect()
    assert len(out) == 1  # one assigned case is not enough
    r = out[0]
    assert (r.cnt_p1, r.cnt_p2, r.total_assigned, r.pct_p1_cases, r.pct_p1p2_cases) == (1, 1, 2, 50.0, 100.0)


def test_resolution_counts_same_month_only(rows):
    cases = rows(
        CASES,
        (1, 9, "n", "P1", ts(2024, 1, 2), ts(2024, 1, 31), None, 4.0),
        (2, 9, "n", "P1", ts(2024, 1, 3), ts(2024, 2, 1), None, None),
        (3, 9, "n", "P1", ts(2024, 3, 3), None, None, None),
        (4, 9, "n", "P1", ts(2022, 1, 1), ts(2022, 2, 1), None, 5.0),
    )
    got = {r.case_month: r for r in support.case_resolution(cases, FLOOR).collect()}
    assert set(got) == {date(2024, 1, 1), date(2024, 3, 1)}
    assert got[date(2024, 1, 1)].resolution_rate == 0.5
    assert got[date(2024, 3, 1)].resolution_rate == 0.0 and got[date(2024, 3, 1)].solved_tickets is None
    assert [r.avg_csat_score for r in support.case_satisfaction(cases, FLOOR).collect()] == [4.0]


def test_response_hours_fall_back_and_drop_negatives(rows):
    cases = rows(
        CASES,
        (1, 9, "n", "P1", ts(2024, 1, 2, 10, 0, 30), None, ts(2024, 1, 2, 11, 30), None),
        (2, 9, "n", "P1", ts(2024, 1, 2, 12), ts(2024, 1, 2, 18), None, None),
        (3, 9, "n", "P1", ts(2024, 1, 2), None, None, None),
        (4, 9, "n", "P1", ts(2024, 1, 2), None, ts(2024, 1, 1), None),
    )
    out = support.response_hours(cases, date(2024, 1, 4), FLOOR).orderBy("case_id").collect()
    assert [r.fttr_hrs for r in out] == [1.5, 12.0, 72.0]
    q = support.first_response_time(cases, date(2024, 1, 4), FLOOR).first()
    assert (q.mthly_fttr_25, q.mthly_fttr_50, q.mthly_fttr_75) == (6.75, 12.0, 42.0)


def test_exposure_against_brute_force(spark, data):
    i = Inputs(spark, data)
    live = billing.live_invoices(i.invoices(), i.invoice_customers(), AS_OF, MONTHS)
    by_account = defaultdict(list)
    for r in live.collect():
        by_account[r.account_id].append(r)

    def end(d):
        nxt = date(d.year + d.month // 12, d.month % 12 + 1, 1)
        return date.fromordinal(nxt.toordinal() - 1)

    expected = {}
    for account, invoices in by_account.items():
        for month in {end(r.due_dt) for r in invoices}:
            due = [r for r in invoices if r.due_dt <= month]
            open_ = [r for r in due if r.closed_dt is None]
            days = max([(month - r.due_dt).days for r in open_] + [0] * (len(due) > len(open_)))
            expected[account, month] = (days, sum(r.amount for r in open_), len(open_))
    got = {
        (r.account_id, r.month_end): (r.maximum_days_past_due, r.sum_total_amount_due, r.number_of_open_invoices)
        for r in billing.open_invoice_exposure(live).collect()
    }
    assert got == expected


def test_latest_invoice_breaks_ties_by_transaction(rows):
    live = rows(
        "entity_id long, account_id long, due_dt date, closed_dt date, amount double, status string, transaction_id long",
        (1, 1, date(2024, 1, 5), None, 1.0, "O", 10),
        (1, 1, date(2024, 1, 5), date(2024, 2, 1), 2.0, "F", 11),
    )
    r = billing.latest_invoice(live).first()
    assert (r.recent_invoice_due_amt, r.sum_total_amount_due, r.maximum_days_past_due) == (2.0, 1.0, 26)


def test_competitor_total_is_null_if_a_counter_is(rows):
    us = rows("account_id long, date date, a long, b long", (1, date(2024, 1, 1), 1, None), (2, date(2024, 1, 1), 1, 1))
    eu = rows("account_id long, date date, a long, b long", (2, date(2024, 1, 20), 5, 0))
    got = {r.account_id: r for r in billing.competitor_monthly([us, eu], ["a", "b"]).collect()}
    assert got[1].total_competitor_agents is None
    assert (got[2].a, got[2].b, got[2].total_competitor_agents) == (5, 1, 6)


@pytest.mark.parametrize("column, value", [("churn_risk_score", 0.9)])
def test_last_weekly_score_of_the_month(rows, column, value):
    df = rows(
        "account_id long, date date, churn_risk_score double",
        (1, date(2024, 1, 7), 0.1),
        (1, date(2024, 1, 28), value),
        (1, date(2024, 2, 4), 0.2),
    )
    out = billing.latest_weekly_score(df, [column]).orderBy("score_month").collect()
    assert [r[column] for r in out] == [value, 0.2]


def test_support_metrics_of_dealt_cases_are_the_same(rows):
    cases = rows(
        CASES,
        *[
            (n % 9, n % 3 or None, f"n{n % 2}", f"P{n % 3 + 1}", ts(2024, 1 + n % 2, 2), ts(2024, 1 + n % 2, 3 + n % 5) if n % 4 else None, None, 1.0 + n % 5)
            for n in range(24)
        ],
    )
    history = rows(
        "case_id long, field string, old_value string, created_ts timestamp", (1, "Priority", "P2", ts(2024, 1, 5)), (2, "Status", "P1", ts(2024, 1, 5))
    )
    plain = support.support_metrics(cases, history, date(2024, 5, 1), FLOOR)
    dealt = support.support_metrics(cases, history, date(2024, 5, 1), FLOOR, 3)
    assert plain.columns == dealt.columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, plain.collect()), key=key) == sorted(map(tuple, dealt.collect()), key=key) != []
