"""Account panel: users, activation, product stickiness and utilization."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctpulse.functions import (
    greatest_strict,
    month_diff,
    month_start,
    safe_div,
    zero_if_null,
)
from acctpulse.operators.latest import month_end_or, newest
from acctpulse.operators.rolling import (
    latest_value,
    rolling_avg,
    trailing_median,
    trailing_median_column,
)

HORIZON_MONTHS = 30
TIERS = ("FULL_PLATFORM", "CORE")
OPEN_END = date(9999, 12, 31)


def in_horizon(day: str, as_of: date, months: int, from_month_start: bool = False) -> Column:
    """``day`` in the trailing months up to ``as_of``, both ends included."""
    anchor = month_start(F.lit(as_of)) if from_month_start else F.lit(as_of)
    return F.col(day).between(F.add_months(anchor, -months), F.lit(as_of))


def total_users() -> Column:
    return zero_if_null("core_users") + zero_if_null("full_users")


def trailing_user_median(
    panel: DataFrame, as_of: date, days: int = 60, months: int = HORIZON_MONTHS
) -> DataFrame:
    """Distinct (account, day, users) with the median users of the trailing days."""
    rows = panel.filter(in_horizon("report_dt", as_of, months, from_month_start=True)).select(
        "account_id", "report_dt", total_users().alias("total_users")
    )
    return trailing_median(rows, "account_id", "report_dt", "total_users", days, "rolling_60_day_median")


# Component columns that add up to one amount or price; absent ones count 0.
COMPONENTS = {
    "ingest_bcm": ("ingest_amt", "us_ingest_amt", "eu_ingest_amt"),
    "ingest_unit_price": ("ingest_price", "us_ingest_price", "eu_ingest_price"),
    "ccu_bcm": (
        "us_ccu_amt",
        "us_core_ccu_amt",
        "us_advanced_ccu_amt",
        "eu_ccu_amt",
        "eu_core_ccu_amt",
        "eu_advanced_ccu_amt",
    ),
    "ccu_unit_price": (
        "us_ccu_price",
        "us_core_ccu_price",
        "us_advanced_ccu_price",
        "eu_ccu_price",
        "eu_core_ccu_price",
        "eu_advanced_ccu_price",
    ),
    "users_bcm": ("full_user_amt", "core_user_amt"),
    "users_unit_price": ("full_user_price", "core_user_price"),
}

LATEST = {"latest_program": "program", "latest_acr": "acr", "latest_bcm": "bcm"}


def _sum_parts(columns: Sequence[str]) -> Column:
    first, *rest = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    for c in rest:
        first = first + c
    return first


def enriched_columns() -> dict[str, Column]:
    """Row-local columns of the panel."""
    return {
        "report_month": month_start("report_dt"),
        "months_since_contract_start": month_diff("contract_start", "report_dt"),
        "is_contract_flag": F.when((F.col("acr") > 0) & (F.col("term_end") != F.lit(OPEN_END)), 1).otherwise(0),
        "bcm": F.col("amount_month"),
        **{out: _sum_parts(parts) for out, parts in COMPONENTS.items()},
        "daily_engaged_users": total_users(),
        "committed_users": zero_if_null("min_core_users") + zero_if_null("min_full_users"),
    }


def panel_enrichment(panel: DataFrame, as_of: date, months: int = HORIZON_MONTHS) -> DataFrame:
    rows = panel.filter(in_horizon("report_dt", as_of, months, from_month_start=True))
    rows = rows.withColumns(enriched_columns())
    return latest_value(rows, ["account_id"], "report_dt", LATEST)


def user_activation(
    panel: DataFrame,
    as_of: date,
    months: int = HORIZON_MONTHS,
    one_row_per_day: bool = True,
) -> DataFrame:
    """Seven-row average users against committed or median users.

    All windows run over every day; only then are month ends and the newest
    date kept. With one row per account and day, the panel's grain, the median
    is one more frame of the same window pass. Otherwise it is computed over
    de-duplicated rows and joined back.
    """
    rows = panel_enrichment(panel, as_of, months)
    if one_row_per_day:
        rows = rows.withColumn("_day_no", F.unix_date("report_dt"))
        rows = rows.withColumn(
            "rolling_60_day_median",
            F.when(
                F.col("account_id").isNotNull(),
                trailing_median_column("account_id", "report_dt", "daily_engaged_users"),
            ),
        ).drop("_day_no")
    else:
        medians = trailing_user_median(panel, as_of, months=months).drop("total_users")
        rows = rows.join(medians, ["account_id", "report_dt"], "left")
    rows = rolling_avg(rows, ["account_id"], "report_dt", {"dau_r7d": ("daily_engaged_users", 7)})
    rows = rows.withColumn("denom_users", greatest_strict("committed_users", "rolling_60_day_median"))
    kept = month_end_or(rows, "report_dt", newest(panel, "report_dt"))
    share = F.col("dau_r7d") * 100
    return kept.withColumn(
        "user_activation_percentage",
        F.when(F.col("acr") > 0, safe_div(share, F.col("denom_users"))).when(
            F.col("acr") == 0, safe_div(share, F.col("rolling_60_day_median"))
        ),
    )


def product_stickiness(
    flags: DataFrame, features: Sequence[str], as_of: date, months: int = HORIZON_MONTHS
) -> DataFrame:
    """Share of advanced features in use per account and month.

    A feature counts towards the total when it has any non-NULL value in the
    group, which is what a NULL-dropping unpivot and a distinct count give, but
    without multiplying the rows. Identical input rows count once.
    """
    rows = flags.filter(in_horizon("month", as_of, months)).select(
        "account_id", "month", *features
    ).dropDuplicates()
    per_feature = [F.sum(f).alias(f"_sum_{f}") for f in features]
    seen = [F.max(F.col(f).isNotNull().cast("int")).alias(f"_seen_{f}") for f in features]
    grouped = rows.groupBy("account_id", F.col("month").alias("report_month")).agg(*per_feature, *seen)
    used = sum((F.coalesce(F.col(f"_sum_{f}"), F.lit(0)) for f in features), F.lit(0))
    total = sum((F.col(f"_seen_{f}") for f in features), F.lit(0))
    return (
        grouped.select(
            "account_id",
            "report_month",
            used.cast("long").alias("adv_used_features"),
            total.cast("long").alias("total_adv_features"),
        )
        .filter(F.col("total_adv_features") > 0)
        .withColumn(
            "product_stickiness_ratio",
            safe_div(F.col("adv_used_features") * F.lit(100.0), F.col("total_adv_features")),
        )
    )


def _platform_usage(usage: DataFrame, as_of: date, months: int) -> DataFrame:
    return usage.filter(F.col("tier").isin(*TIERS) & in_horizon("date", as_of, months))


def platform_usage(usage: DataFrame, as_of: date, months: int = HORIZON_MONTHS) -> DataFrame:
    """The rows and columns of usage that ``capability_reach`` and ``daily_active_usage`` read."""
    return _platform_usage(usage, as_of, months).select(
        "date", "account_id", "capability", "tier", "user_id", "datacentre", "daily_active"
    )


def _reach_of_dealt(usage: DataFrame) -> DataFrame:
    """(month, capability, account_count, total_accounts); accounts are told apart inside their buckets."""
    rows = usage.select(month_start("date").alias("month"), "account_id", "capability")
    counted = rows.dropDuplicates().groupBy("month", "capability").agg(F.count("account_id").alias("account_count"))
    accounts = rows.select("month", "account_id").dropDuplicates()
    totals = accounts.groupBy("month").agg(F.count("account_id").alias("total_accounts"))
    return counted.join(totals, "month", "left")


def capability_reach(
    usage: DataFrame, as_of: date, months: int = HORIZON_MONTHS, dealt: bool = False
) -> DataFrame:
    """Per month and capability: share of the month's accounts that use it.

    ``dealt``: usage is a table dealt by account, which may be read twice. Else:

    The fact is read once and reduced to the set of capabilities of each month
    and account, at most as long as there are capabilities. Each set counts its
    account for its capabilities and, by one more entry, for the month.
    """
    share = safe_div(F.col("account_count") * F.lit(100.0), F.col("total_accounts")).alias("usage_percentage")
    columns = ["month", "capability", "account_count", "total_accounts", share]
    if dealt:
        return _reach_of_dealt(_platform_usage(usage, as_of, months)).select(*columns)
    sets = (
        _platform_usage(usage, as_of, months)
        .select(month_start("date").alias("month"), "account_id", "capability")
        .groupBy("month", "account_id")
        .agg(F.collect_set(F.struct(F.lit(False).alias("whole"), "capability")).alias("used"))
    )
    whole = F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("capability"))
    counted = (
        sets.select("month", "account_id", F.explode(F.array_append("used", whole)).alias("u"))
        .groupBy("month", "u.whole", "u.capability")
        .agg(F.count("account_id").alias("account_count"))
    )
    # A window over the capabilities of one month.
    total = F.max(F.when(F.col("whole"), F.col("account_count"))).over(Window.partitionBy("month"))
    return (
        counted.withColumn("total_accounts", F.when(F.col("month").isNotNull(), total))
        .filter(~F.col("whole"))
        .select(*columns)
    )


def threshold_capabilities(reach: DataFrame, percent: float = 3.0) -> DataFrame:
    return reach.filter(F.col("usage_percentage") >= percent).select("month", "capability")


def capability_threshold(reach: DataFrame, percent: float = 3.0) -> DataFrame:
    """Per month: number of capabilities whose reach meets the threshold."""
    return threshold_capabilities(reach, percent).groupBy("month").agg(
        F.count_distinct("capability").alias("total_features_3_percent")
    )


def daily_active_usage(
    usage: DataFrame,
    account_flags: DataFrame,
    account_metrics: DataFrame,
    as_of: date,
    months: int = HORIZON_MONTHS,
    reach: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Distinct users and distinct threshold capabilities per account and day.

    ``reach`` is ``capability_reach`` of the same usage, for callers that have
    it as a table; else it is computed. ``dealt``: usage is a table dealt by
    account, which may be read twice.
    Eligibility depends on account and day alone, so it is applied to the
    aggregated rows as a semi join, which also cannot multiply them.
    """
    reach = capability_reach(usage, as_of, months) if reach is None else reach
    popular = threshold_capabilities(reach).withColumn("meets_threshold", F.lit(True))
    # Usage repeats a user and a capability many times a day; only distinct rows are joined and counted.
    active = (
        _platform_usage(usage, as_of, months)
        .filter("daily_active")
        .select("date", "account_id", F.concat("user_id", "datacentre").alias("person"), "capability")
    )
    active = active if dealt else active.dropDuplicates()
    key = ["date", "account_id", "month"]
    if dealt:
        # Each count of its own rows stays in its bucket, where two distinct counts at once are shuffled.
        people = active.withColumn("month", month_start("date")).select(*key, "person").dropDuplicates()
        features = active.withColumn("month", month_start("date")).select(*key, "capability").dropDuplicates()
        features = features.join(popular, ["month", "capability"]).groupBy("date", "account_id")
        daily = (
            people.groupBy(*key)
            .agg(F.count("person").alias("dau_actuals"))
            .join(features.agg(F.count("capability").alias("_used")), ["date", "account_id"], "left")
            .select(*key, "dau_actuals", F.coalesce("_used", F.lit(0).cast("long")).alias("used_features_3_percent"))
        )
    else:
        daily = (
            active.withColumn("month", month_start("date"))
            .join(popular, ["month", "capability"], "left")
            .groupBy(*key)
            .agg(
                F.count_distinct("person").alias("dau_actuals"),
                F.count_distinct(F.when(F.col("meets_threshold"), F.col("capability"))).alias(
                    "used_features_3_percent"
                ),
            )
        )
    eligible = account_flags.filter("paid_account_flag").join(
        account_metrics, ["date", "account_id"], "left"
    ).filter(F.col("paid_user_eligible") | F.col("qbp_eligible"))
    return daily.join(eligible, ["date", "account_id"], "left_semi")


def stickiness_utilization(
    panel: DataFrame,
    daily: DataFrame,
    thresholds: DataFrame,
    as_of: date,
    months: int = HORIZON_MONTHS,
) -> DataFrame:
    """User stickiness (7 against 30 rows) and product utilization over panel days."""
    base = (
        panel.filter(in_horizon("report_dt", as_of, months))
        .select("account_id", "report_dt", "acr")
        .join(
            daily.select("account_id", F.col("date").alias("report_dt"), "dau_actuals", "used_features_3_percent"),
            ["account_id", "report_dt"],
            "left",
        )
        .withColumn("month", month_start("report_dt"))
        .join(thresholds, "month", "left")
        .select(
            "account_id",
            "report_dt",
            zero_if_null("dau_actuals").alias("dau_actuals"),
            zero_if_null("used_features_3_percent").alias("used_features"),
            "total_features_3_percent",
        )
        .dropDuplicates()
    )
    rolled = rolling_avg(
        base,
        ["account_id"],
        "report_dt",
        {
            "dau_r30d": ("dau_actuals", 30),
            "dau_r7d": ("dau_actuals", 7),
            "total_features_r7d": ("total_features_3_percent", 7),
            "used_features_r7d": ("used_features", 7),
        },
    )
    return rolled.withColumns(
        {
            "last_day_of_month": F.last_day("report_dt"),
            "user_stickiness_ratio": F.coalesce(
                safe_div(F.col("dau_r7d") * 100.0, F.round("dau_r30d", 1)), F.lit(0.0)
            ),
            "product_utilization_rate": safe_div(
                F.col("used_features_r7d") * 100.0, F.round("total_features_r7d", 1)
            ),
        }
    )
