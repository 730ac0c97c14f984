from datetime import date

import pytest
from pyspark.sql import functions as F

from acctpulse.plans import finance

OPEN = date(9999, 12, 31)


def test_contract_buckets_share_edges_first_match_wins(rows):
    ends = [date(2021, 1, 1), date(2022, 1, 1), date(2023, 1, 1), date(2023, 2, 1), OPEN]
    df = rows(
        "acr double, term_start date, term_end date",
        *[(100.0, date(2020, 1, 1), e) for e in ends],
        (0.0, date(2020, 1, 1), ends[0]),
    )
    out = finance.contract_terms(df).collect()
    assert [r.contract_length_mths for r in out] == [12, 24, 36, 37, None, None]
    assert [r.contract_length_score for r in out] == [25, 50, 75, 100, None, None]


@pytest.mark.parametrize(
    "growth, score", [(-10.0, 0.0), (-1.0, 24.0), (0.0, 31.0), (5.0, 61.0), (15.0, 81.0), (40.0, 100.0), (None, 50.0)]
)
def test_growth_score_pieces(rows, growth, score):
    df = rows(
        "first_report_date date, report_dt date, revenue_growth double",
        (date(2023, 1, 1), date(2024, 1, 31), growth),
        (date(2023, 12, 1), date(2024, 1, 31), growth),
    )
    assert [r.revenue_growth_score for r in finance.growth_score(df).collect()] == [score, 50.0]


def test_growth_base_is_one_when_prior_average_is_zero(rows):
    df = rows(
        "account_id long, report_dt date, amount_month double",
        (1, date(2024, 1, 31), 0.0),
        (1, date(2024, 2, 29), 3.0),
    )
    out = finance.revenue_growth(finance.bcm_per_day(df)).orderBy("report_dt").collect()
    assert [r.revenue_growth for r in out] == [None, 200.0]


def test_forward_amounts_null_ahead_zero_when_missing(rows):
    df = rows(
        "account_id long, report_dt date, amount_month double",
        (1, date(2024, 1, 31), 10.0),
        (1, date(2024, 2, 29), 20.0),
    )
    out = finance.forward_bcm(df, date(2024, 3, 31)).orderBy("report_dt").collect()
    assert [r.m_plus_1_bcm for r in out] == [20.0, 0.0]
    assert [r.m_plus_3_bcm for r in out] == [None, None]
    assert [r.pct_m_plus_1_bcm for r in out] == [100.0, -100.0]


def test_overage_only_for_volume_programs_above_commitment(rows):
    df = rows(
        "program string, mtd_amount double, min_commit double",
        ("Volume Plan", 150.0, 100.0),
        ("volume x", 100.0, 100.0),
        ("PAYG", 150.0, 100.0),
        ("Volume", 5.0, 0.0),
    )
    out = finance.overage(df).collect()
    assert [r.overages for r in out] == [50.0, None, None, None]
    assert out[0].overage_score == pytest.approx(0.5856, abs=1e-4)


def test_renewal_month_zero_reads_one(rows):
    df = rows(
        "term_start date, report_dt date, renewal_dt date",
        (date(2024, 1, 1), date(2024, 3, 1), date(2024, 3, 31)),
    )
    r = finance.renewal_countdown(df, date(2024, 5, 1)).first()
    assert (r.months_until_renewal, r.days_until_renewal, r.mths_till_date, r.mth_diff) == (1, 30, 2, 2)


def panel(rows, *tuples):
    return rows(
        "account_id long, report_dt date, account_name string, term_start date, amount_month double,"
        " min_commit double, ctd_amount double",
        *tuples,
    )


def test_term_to_date_restarts_with_the_term(rows):
    t1, t2 = date(2024, 1, 10), date(2024, 3, 1)
    df = panel(
        rows,
        (1, date(2024, 1, 31), "a", t1, 5.0, 10.0, 0.0),
        (1, date(2024, 2, 10), "a", t1, 12.0, 10.0, 0.0),
        (1, date(2024, 2, 29), "a", t1, 20.0, 10.0, 0.0),
        (1, date(2024, 3, 31), "a", t2, 30.0, 10.0, 0.0),
        (1, date(2024, 4, 30), "a", t2, None, 10.0, 0.0),
    )
    out = finance.term_to_date_updated(df, date(2024, 5, 1)).orderBy("report_dt").collect()
    assert [r.ctd_updated for r in out] == [10.0, 22.0, 30.0, 30.0, None]


def test_burn_down_only_for_open_ended_contracts(rows):
    schema = (
        "acr double, term_end date, l3m_bcm double, l3m_bcm_days double, day_wise_acr double, month_wise_acr double,"
        " amount_left double, days_until_renewal int, months_until_renewal int"
    )
    df = rows(
        schema,
        (10.0, OPEN, 4.0, 2.0, 8.0, 16.0, 40.0, 10, 5),
        (10.0, date(2025, 1, 1), 0.0, 0.0, 0.0, 16.0, 40.0, 10, 5),
    )
    a, b = finance.burn_down(df).collect()
    assert (a.day_temperature, a.month_temperature, a.days_to_deplete) == (0.5, 0.25, 20.0)
    assert (a.renewal_urgency_days, a.renewal_urgency_months) == (2.0, 2.0)
    assert (b.day_temperature, b.days_to_deplete, b.months_to_deplete) == (None, None, 40.0)
    assert b.renewal_urgency_days is None and b.renewal_urgency_months is None


def test_amount_per_day_divides_by_one_day_less(rows):
    df = rows("report_dt date, amount_month double", (date(2024, 2, 10), 56.5))
    r = finance.bcm_per_day(df).first()
    assert (r.bcm, r.days_in_month, r.day_wise_bcm) == (57.0, 29, 56.5 / 28)
    assert df.select(F.round("amount_month", 0)).first()[0] == 57.0
