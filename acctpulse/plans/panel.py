"""The wide account panel: one row per account and report date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.functions import dec2
from acctpulse.operators.assembly import dealt_join
from acctpulse.operators.latest import month_end_or, newest
from acctpulse.plans import billing, finance, support, usage
from acctpulse.session import DEALT_MB, materialize, materialize_dealt, parts_for


@dataclass(frozen=True)
class PanelSources:
    """Logical inputs of the panel."""

    panel: DataFrame
    feature_flags: DataFrame
    features: Sequence[str]
    feature_usage: DataFrame
    account_flags: DataFrame
    account_metrics: DataFrame
    cases: DataFrame
    case_history: DataFrame
    risk_weekly: DataFrame
    sentiment_weekly: DataFrame
    invoices: DataFrame
    invoice_customers: DataFrame
    competitor_regions: Sequence[DataFrame]
    counters: Sequence[str]


def account_360(
    s: PanelSources,
    as_of: date,
    months: int = usage.HORIZON_MONTHS,
    case_floor: date = support.CASE_FLOOR,
    parts: int | None = None,
) -> DataFrame:
    """All branches on the activation rows.

    Every branch is aggregated to (account, date) or (account, month) before
    assembly, so that moves calendar-bounded rows, never raw facts. What several
    branches read is written once, dealt by account into as many buckets as the
    input asks for; windows, groupings and joins by account then need no other
    shuffle, and neither do sources that come dealt so already. Without shuffles
    all branches would run in one task per bucket, so the larger ones are written
    as well, before the sorts of one task hold too much memory.
    """
    parts = parts or parts_for(s.panel, s.feature_usage, mb=DEALT_MB)
    panel = materialize_dealt(s.panel, "account_panel_rows", parts, "account_id")
    used = materialize_dealt(
        usage.platform_usage(s.feature_usage, as_of, months), "platform_usage", parts, "account_id"
    )
    all_cases = materialize_dealt(s.cases, "support_cases", parts, "account_id")
    # One row per month and capability; both the thresholds and the daily counts read it.
    reach = materialize(usage.capability_reach(used, as_of, months, dealt=True), "capability_reach")
    thresholds = usage.capability_threshold(reach)
    daily = usage.daily_active_usage(used, s.account_flags, s.account_metrics, as_of, months, reach, dealt=True)
    daily = materialize_dealt(daily, "daily_active_usage", parts, "account_id")
    base = usage.user_activation(panel, as_of, months).drop("mtd_amount")

    stickiness = usage.product_stickiness(s.feature_flags, s.features, as_of, months).withColumn(
        "product_stickiness_ratio", dec2("product_stickiness_ratio")
    )
    # The rolling measures need every day; only the panel's dates go on to the join.
    rolled = usage.stickiness_utilization(panel, daily, thresholds, as_of, months)
    rolled = month_end_or(rolled, "report_dt", newest(panel, "report_dt")).select(
        "account_id",
        "report_dt",
        "dau_actuals",
        "used_features",
        "total_features_3_percent",
        "dau_r30d",
        dec2("user_stickiness_ratio").alias("user_stickiness_ratio"),
        "total_features_r7d",
        "used_features_r7d",
        dec2("product_utilization_rate").alias("product_utilization_rate"),
    )
    rolled = materialize_dealt(rolled, "stickiness_utilization", parts, "account_id")
    money = finance.financial_metrics(panel, as_of, months).select(
        "account_id",
        "report_dt",
        "total_acr",
        "l3m_bcm",
        "day_wise_acr",
        "month_wise_acr",
        "amount_left",
        "ctd_updated",
        "day_temperature",
        "month_temperature",
        "days_to_deplete",
        "months_to_deplete",
        "days_until_renewal",
        "months_until_renewal",
        "first_report_date",
        *[
            dec2(c).alias(c)
            for c in (
                "renewal_urgency_months",
                "renewal_urgency_days",
                "overages",
                "overage_score",
                "revenue_growth",
                "revenue_growth_score",
                "contract_length_mths",
                "contract_length_score",
            )
        ],
        "mtd_amount",
        *[f"m_plus_{n}_bcm" for n in finance.FORWARD_MONTHS],
        "target_m_plus_6_bcm",
        "target_m_plus_12_bcm",
        "pct_m_plus_1_bcm",
        "pct_m_plus_3_bcm",
        "pct_m_plus_6_bcm",
        "pct_m_plus_12_bcm",
        "consumed_month_number",
        "consumed_month_number_per_subscription",
        "mth_diff",
        "mths_till_date",
    )
    money = materialize_dealt(money, "financial_metrics", parts, "account_id")
    cases = support.support_metrics(all_cases, s.case_history, as_of, case_floor, parts).select(
        F.col("account_id").alias("crm_account_id"),
        F.col("case_month").alias("report_month"),
        *[
            dec2(c).alias(c)
            for c in (
                "pct_p1_cases",
                "pct_p1p2_cases",
                "resolution_rate",
                "open_tickets",
                "avg_csat_score",
                "mthly_fttr_50",
            )
        ],
    )
    risk = billing.latest_weekly_score(s.risk_weekly, ["churn_risk_score"]).select(
        "account_id", F.col("score_month").alias("report_month"), dec2("churn_risk_score").alias("churn_risk_score")
    )
    sentiment = billing.latest_weekly_score(
        s.sentiment_weekly, ["sentiment_score", "engagement_score"]
    ).select(
        "account_id",
        F.col("score_month").alias("report_month"),
        dec2("sentiment_score").alias("sentiment_score"),
        dec2("engagement_score").alias("engagement_score"),
    )
    live = billing.live_invoices(s.invoices, s.invoice_customers, as_of, months)
    invoices = billing.latest_invoice(live).select(
        "account_id",
        F.col("invoice_month").alias("report_month"),
        *[
            dec2(c).alias(c)
            for c in ("maximum_days_past_due", "sum_total_amount_due", "number_of_open_invoices")
        ],
    )
    invoices = materialize_dealt(invoices, "latest_invoice", parts, "account_id")
    competitors = billing.competitor_monthly(s.competitor_regions, s.counters).withColumnRenamed(
        "reporting_month", "report_month"
    )

    month_key, day_key = ["account_id", "report_month"], ["account_id", "report_dt"]
    activated = base.select(*BASE_COLUMNS).withColumn(
        "user_activation_percentage", dec2("user_activation_percentage")
    )
    activated = materialize_dealt(activated.dropDuplicates(), "user_activation", parts, "account_id")
    # A customer system's account may stand for many accounts, so this one is a join, whose skew is split at run time.
    by_day = dealt_join(activated, day_key, rolled, money)
    competitors = competitors.repartition(parts, "account_id")
    # Branches by month have one row per key.
    by_month = dealt_join(
        by_day, month_key, stickiness, risk, sentiment, invoices, competitors, distinct=False
    )
    return by_month.join(cases, ["crm_account_id", "report_month"], "left")


BASE_COLUMNS = (
    "account_id",
    "effective_account_id",
    "crm_account_id",
    "account_name",
    "report_dt",
    "report_month",
    "program",
    "latest_program",
    "acr",
    "is_contract_flag",
    "latest_acr",
    "bcm",
    "latest_bcm",
    "ingest_bcm",
    "ingest_unit_price",
    "ccu_bcm",
    "ccu_unit_price",
    "users_bcm",
    "users_unit_price",
    "term_start",
    "term_end",
    "renewal_dt",
    "multiyear_flag",
    "industry",
    "country",
    "geo",
    "region",
    "sub_region",
    "employees",
    "churn_indicator",
    "contract_start",
    "months_since_contract_start",
    "daily_engaged_users",
    "dau_r7d",
    "committed_users",
    "rolling_60_day_median",
    "denom_users",
    "user_activation_percentage",
    "min_commit",
    "ctd_amount",
    "qtd_amount",
    "ytd_amount",
)
