"""Account panel: consumption to date, contract, growth and burn-down measures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctpulse.functions import (
    days_between,
    greatest_strict,
    least_strict,
    month_diff,
    month_start,
    previous_month_end,
    safe_div,
    year_diff,
    zero_if_null,
)
from acctpulse.operators.latest import month_end_or, newest
from acctpulse.operators.rolling import ordered, prior_avg, running_sum
from acctpulse.plans.usage import HORIZON_MONTHS, OPEN_END

TERM = ["account_id", "term_start"]
FORWARD_MONTHS = (1, 3, 4, 5, 6, 10, 11, 12)


def billed_amount() -> Column:
    """The larger of consumption and commitment; NULL if either is missing."""
    return greatest_strict("amount_month", "min_commit")


def term_to_date(panel: DataFrame, as_of: date) -> DataFrame:
    """Running billed amount within the contract term, over month ends and yesterday."""
    rows = month_end_or(panel, "report_dt", F.date_sub(F.lit(as_of), 1)).select(
        "account_id",
        "report_dt",
        "account_name",
        "term_start",
        "amount_month",
        "min_commit",
        "ctd_amount",
    )
    return running_sum(rows, TERM, "report_dt", {"ctd_modified": billed_amount()})


def term_to_date_updated(panel: DataFrame, as_of: date, months: int = HORIZON_MONTHS) -> DataFrame:
    """Prior month-end total plus this row's billed amount; a term's first month starts anew."""
    prior = term_to_date(panel, as_of).select(
        "account_id", "term_start", F.col("report_dt").alias("prior_month_end"), "ctd_modified"
    )
    rows = (
        panel.filter(F.col("report_dt") >= F.add_months(F.lit(as_of), -months))
        .select(
            "account_id",
            "report_dt",
            "account_name",
            "term_start",
            "amount_month",
            "min_commit",
            "ctd_amount",
        )
        .withColumn("prior_month_end", previous_month_end("report_dt"))
    )
    w = Window.partitionBy(*TERM).orderBy(month_start("report_dt"))
    joined = rows.join(prior, ["account_id", "term_start", "prior_month_end"], "left")
    first_month = (month_diff("term_start", "report_dt") == 0) | (F.dense_rank().over(w) == 1)
    return joined.withColumn("_first", first_month).select(
        "account_id",
        "report_dt",
        "account_name",
        "term_start",
        "amount_month",
        "min_commit",
        "ctd_amount",
        "ctd_modified",
        F.when(F.col("_first"), billed_amount())
        .otherwise(F.col("ctd_modified") + billed_amount())
        .alias("ctd_updated"),
    )


def contract_columns() -> dict[str, Column]:
    """Contract length and its score, for running contracts with an end date."""
    contract = (F.col("acr") > 0) & (F.col("term_end") != F.lit(OPEN_END))
    months = month_diff("term_start", "term_end")
    return {
        "contract_length_mths": F.when(contract, months),
        # the buckets share their edges; the first match wins
        "contract_length_score": F.when(contract & months.between(0, 12), 25)
        .when(contract & months.between(12, 24), 50)
        .when(contract & months.between(24, 36), 75)
        .when(contract & (months > 36), 100),
        "contract_yrs": F.when(contract, year_diff("term_start", "term_end")),
    }


def contract_terms(df: DataFrame) -> DataFrame:
    return df.withColumns(contract_columns())


def spread_columns() -> dict[str, Column]:
    """Contract value in total, per day and per month of the term."""
    total = F.col("acr") * year_diff("term_start", "term_end")
    return {
        "total_acr": total,
        "day_wise_acr": safe_div(total, days_between("term_start", "term_end")),
        "month_wise_acr": safe_div(total, month_diff("term_start", "term_end")),
    }


def acr_spread(df: DataFrame) -> DataFrame:
    """Adds the spread and the amount left after ``ctd_updated``."""
    return df.withColumns(spread_columns()).withColumn(
        "amount_left", F.col("total_acr") - F.col("ctd_updated")
    )


def overage_column() -> Column:
    """Percent over commitment, for volume programs above it."""
    over = F.col("mtd_amount") - F.col("min_commit")
    return F.when(
        F.col("program").ilike("volume%") & (over > 0), safe_div(over * 100.0, F.col("min_commit"))
    )


def overage_score_column() -> Column:
    return safe_div(F.lit(1.0), F.log10(1 + F.round("overages", 1)))


def overage(df: DataFrame) -> DataFrame:
    return df.withColumn("overages", overage_column()).withColumn(
        "overage_score", overage_score_column()
    )


def renewal_columns(as_of: date) -> dict[str, Column]:
    months = month_diff("report_dt", "renewal_dt")
    return {
        "mths_till_date": month_diff("report_dt", F.lit(as_of)),
        "months_until_renewal": F.when(months == 0, 1).otherwise(months),
        "days_until_renewal": days_between("report_dt", "renewal_dt"),
        "mth_diff": month_diff("term_start", "report_dt"),
    }


def renewal_countdown(df: DataFrame, as_of: date) -> DataFrame:
    return df.withColumns(renewal_columns(as_of))


def amount_columns() -> dict[str, Column]:
    span = days_between(month_start("report_dt"), F.last_day("report_dt"))
    return {
        "bcm": F.round("amount_month", 0),
        "days_in_month": span + 1,
        # divides by one day less than the month has, as the metric is defined
        "day_wise_bcm": safe_div("amount_month", span),
    }


def bcm_per_day(df: DataFrame) -> DataFrame:
    return df.withColumns(amount_columns())


def first_report_date(panel: DataFrame) -> DataFrame:
    return panel.groupBy("account_id").agg(F.min("term_start").alias("first_report_date"))


def forward_columns(as_of: date) -> dict[str, Column]:
    """Amount n rows ahead: NULL while the month lies ahead of ``as_of``, 0 if it passed without a row."""
    w = ordered(["account_id"], "report_dt")

    def ahead(n: int) -> Column:
        not_yet = F.add_months("report_dt", n) > F.lit(as_of)
        return F.when(~not_yet, F.coalesce(F.lead("amount_month", n).over(w), F.lit(0.0)))

    return {f"m_plus_{n}_bcm": ahead(n) for n in FORWARD_MONTHS}


def target_columns() -> dict[str, Column]:
    def mean3(a: int, b: int, c: int) -> Column:
        return (F.col(f"m_plus_{a}_bcm") + F.col(f"m_plus_{b}_bcm") + F.col(f"m_plus_{c}_bcm")) / 3

    return {"target_m_plus_6_bcm": mean3(4, 5, 6), "target_m_plus_12_bcm": mean3(10, 11, 12)}


def change_columns() -> dict[str, Column]:
    def change(ahead: str) -> Column:
        now = zero_if_null("bcm")
        return safe_div((zero_if_null(ahead) - now) * 100, now)

    return {
        "pct_m_plus_1_bcm": change("m_plus_1_bcm"),
        "pct_m_plus_3_bcm": change("m_plus_3_bcm"),
        "pct_m_plus_6_bcm": change("target_m_plus_6_bcm"),
        "pct_m_plus_12_bcm": change("target_m_plus_12_bcm"),
    }


def forward_bcm(df: DataFrame, as_of: date) -> DataFrame:
    """Forward amounts, their targets and percent changes, over month-end rows."""
    return (
        df.withColumns({"bcm": F.round("amount_month", 0), **forward_columns(as_of)})
        .withColumns(target_columns())
        .withColumns(change_columns())
    )


def numbering_columns() -> dict[str, Column]:
    return {
        "consumed_month_number": F.row_number().over(ordered(["account_id"], "report_dt")),
        "consumed_month_number_per_subscription": F.row_number().over(ordered(TERM, "report_dt")),
    }


def month_numbering(df: DataFrame) -> DataFrame:
    return df.withColumns(numbering_columns())


def _growth_base() -> Column:
    return F.when(F.col("l3m_bcm") == 0, F.col("l3m_bcm") + 1).otherwise(F.col("l3m_bcm"))


def revenue_growth(df: DataFrame) -> DataFrame:
    """Percent growth over the mean of the three rows before (1 where that is 0)."""
    averaged = prior_avg(
        df,
        ["account_id"],
        "report_dt",
        {"l3m_bcm": zero_if_null("bcm"), "l3m_bcm_days": zero_if_null("day_wise_bcm")},
    )
    growth = safe_div((zero_if_null("bcm") - _growth_base()) * 100, F.round(_growth_base(), 1))
    return averaged.withColumn("revenue_growth", growth)


def growth_score_column() -> Column:
    """Piecewise growth score; 50 for young accounts and unknown growth."""
    mature = month_diff("first_report_date", "report_dt") > 3
    g = F.col("revenue_growth")
    return (
        F.when(mature & (g < 0), greatest_strict(F.lit(0.0), 30 + g * 6))
        .when(mature & (g >= 0) & (g < 5), 31 + g * 6)
        .when(mature & (g >= 5) & (g < 15), 61 + (g - 5) * 2)
        .when(mature & (g >= 15), least_strict(F.lit(100.0), 81 + (g - 15) * 2))
        .otherwise(F.lit(50.0))
    )


def growth_score(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue_growth_score", growth_score_column())


def burn_down(df: DataFrame) -> DataFrame:
    """Consumption pace against the contract, time to depletion, renewal urgency."""
    open_ended = (F.col("acr") > 0) & (F.col("term_end") == F.lit(OPEN_END))
    return df.withColumns(
        {
            "day_temperature": F.round(safe_div("l3m_bcm", F.round("day_wise_acr", 1)), 2),
            "month_temperature": F.round(safe_div("l3m_bcm", F.round("month_wise_acr", 1)), 2),
            "days_to_deplete": safe_div("amount_left", F.round("l3m_bcm_days", 1)),
            "months_to_deplete": safe_div("amount_left", F.round(_growth_base(), 1)),
        }
    ).withColumns(
        {
            "renewal_urgency_days": F.when(
                open_ended, safe_div("days_to_deplete", F.col("days_until_renewal"))
            ),
            "renewal_urgency_months": F.when(
                open_ended, safe_div("months_to_deplete", F.col("months_until_renewal"))
            ),
        }
    )


def financial_base(panel: DataFrame, as_of: date, months: int = HORIZON_MONTHS) -> DataFrame:
    """Row-local and forward measures on month-end rows and the newest date."""
    kept = month_end_or(panel, "report_dt", newest(panel, "report_dt"))
    to_date = term_to_date_updated(panel, as_of, months).select("account_id", "report_dt", "ctd_updated")
    rows = (
        kept.select(
            "account_id",
            "report_dt",
            "program",
            "acr",
            "term_start",
            "term_end",
            "renewal_dt",
            "amount_month",
            "min_commit",
            "ctd_amount",
            "qtd_amount",
            "ytd_amount",
            "mtd_amount",
        )
        .join(first_report_date(panel), "account_id", "left")
        .join(to_date, ["account_id", "report_dt"], "left")
    )
    rows = acr_spread(rows).withColumns(
        {
            **contract_columns(),
            "overages": overage_column(),
            **renewal_columns(as_of),
            **amount_columns(),
            **forward_columns(as_of),
        }
    )
    return month_numbering(rows)


def financial_metrics(panel: DataFrame, as_of: date, months: int = HORIZON_MONTHS) -> DataFrame:
    """The finance branch. Prior averages see all rows; the horizon is cut after them."""
    rows = revenue_growth(financial_base(panel, as_of, months))
    rows = rows.withColumns({"overage_score": overage_score_column(), **target_columns()})
    rows = rows.filter(F.col("report_dt") >= F.add_months(F.lit(as_of), -months))
    return growth_score(burn_down(rows).withColumns(change_columns()))
