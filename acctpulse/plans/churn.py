"""Weekly churn features: a spine of account weeks and thirteen feature sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctpulse.functions import (
    days_between,
    div0,
    flag01,
    month_diff,
    or_na,
    week_close_after,
    week_close_before,
)
from acctpulse.operators.assembly import lag_lists
from acctpulse.operators.effective import weekly_presence
from acctpulse.operators.lags import lag_features, lag_name, with_ratios
from acctpulse.operators.latest import latest_slice, newest, top_row
from acctpulse.operators.reshape import distinct_list, presence_flags
from acctpulse.operators.rolling import rolling_avg
from acctpulse.plans.billing import COMPETITOR_COUNTERS
from acctpulse.session import spread

KEY = ["account_id", "close_week"]
FLOOR = date(2023, 8, 1)
OPEN_END = date(9999, 12, 31)

# Fixed values.
CHURN_CHANNELS = ("SALES_LED", "Cancelled Account")
DOWNGRADE_CLASSES = ("EXISTING BUSINESS - DOWNGRADE", "LATE RENEWAL - DOWNGRADE")
#: Labels that say that a category is unknown.
PLACEHOLDERS = {"temperature": ("NOT APPLICABLE",), "sentiment_rating": ("NOT UPDATED", "Unknown")}
SHORT_LAGS = (0, 1, 2, 4, 8, 12)
LONG_LAGS = (0, 4, 8, 12, 24)

# Product capabilities by family. Anything else is 'Unattributed'.
# Entries that carry the vendor's own brand are left out; pass them as ``extra_capabilities``.
CAPABILITY_FAMILIES = {
    "Alerts_AIOps": (
        "Alert Conditions",
        "AIOps Alerts",
        "AIOps",
        "Model Performance",
        "Change Tracking",
        "Alerts",
        "Lookout",
        "ML Ops",
        "Grok",
        "Detection",
    ),
    "APIs": ("RPM API", "Insights API"),
    "APM": (
        "APM",
        "Errors Inbox",
        "Serverless",
        "Infinite Tracing",
        "Recommendations",
        "Catalog Apps",
        "Traces",
        "AI Monitoring",
        "AWS Lambda Setup",
        "Custom Applications",
        "Key Transactions",
        "Distrubuted Tracing",
        "Open Telemetry",
        "Product Notifications",
    ),
    "Dashboards": (
        "Query Your Data",
        "Data Explorer",
        "Public Dashboards",
        "Public Charts",
        "Dashboards",
        "Legacy Charts",
    ),
    "DEM": ("Mobile", "Browser", "Synthetics", "Automated Testing", "Website Performance Monitoring"),
    "Developer_Portal": (
        "Teams",
        "Events to Metrics",
        "Entities & Relationships",
        "Explorer",
        "Service Level Management",
        "Event to Metrics",
        "Entities & Relationships API",
        "All Entities",
        "Workloads",
    ),
    "Infra": ("K8s Cluster Explorer", "Prometheus API", "Network", "Infrastructure", "Fleet", "Kubernetes"),
    "Logs": ("Logs",),
    "Security": ("Vulnerability Management", "IAST", "Security"),
    "Shared_Platforms": (
        "Other",
        "Add Data",
        "Internal Monitoring",
        "View Your Usage",
        "API Keys",
        "All Capabilities",
        "User Preferences",
        "Terraform",
        "Saved Views",
        "Discussions",
        "Manage Your Plan",
        "User Migration",
        "Manage Your Data Standalone",
        "Account Settings",
        "Administration",
        "Account Management",
    ),
}

# Flags and the family each of them tests.
FAMILY_FLAGS = {
    "is_apm": "APM",
    "is_aiops": "Alerts_AIOps",
    "is_api": "APIs",
    "is_dash": "Dashboards",
    "is_dem": "DEM",
    "is_infra": "Infra",
    "is_logs": "Logs",
    "is_security": "Security",
    "is_shared_platform": "Shared_Platforms",
}

# Fixed values.
SUBSCRIPTION_FLAGS = (
    "is_paid_ingest_eligible",
    "is_paid_users_eligible",
    "is_paid_account_eligible",
    "is_tiered_pricing",
    "is_paid_synthetics_eligible",
    "is_paid_qbp_eligible",
    "is_ccu_account",
)


# -- spine ----------------------------------------------------------------------------


def _self_parent() -> Column:
    return F.col("account_id") == F.col("effective_account_id")


def churn_dates(panel: DataFrame) -> DataFrame:
    """Accounts whose last active date lies before the newest panel date.

    Channel and exclusion are those of the rows on that last active date.
    """
    last = (
        panel.filter((F.col("churn_indicator") == "N") & _self_parent())
        .groupBy("effective_account_id")
        .agg(F.max("report_dt").alias("churn_date"))
        .filter(F.col("churn_date") < newest(panel, "report_dt"))
    )
    on_last_day = panel.filter(
        F.col("sales_channel").isin(*CHURN_CHANNELS) & ~F.col("exclusion_flag")
    ).select("effective_account_id", F.col("report_dt").alias("churn_date"), "sales_channel")
    return (
        on_last_day.join(last, ["effective_account_id", "churn_date"])
        .select(
            F.col("effective_account_id").alias("account_id"),
            "sales_channel",
            "churn_date",
            week_close_before("churn_date").alias("churn_close_week"),
        )
        .dropDuplicates()
    )


def downgrade_weeks(changes: DataFrame, floor: date = FLOOR, at_most: float = -0.05) -> DataFrame:
    """Last closing week whose first downgrade record is a real reduction."""
    rows = changes.filter(
        F.col("change_class").isin(*DOWNGRADE_CLASSES) & (F.col("report_dt") >= F.lit(floor))
    ).withColumn("week", F.trunc("report_dt", "week"))
    first = top_row(
        rows,
        ["account_id", "week"],
        [F.col(c).asc_nulls_last() for c in ("report_dt", "acr_now", "acr_change")],
    )
    return (
        first.filter(div0("acr_change", "acr_now") <= at_most)
        .groupBy("account_id")
        .agg(F.max(week_close_before("report_dt")).alias("downgrade_close_week"))
    )


def weekly_spine(panel: DataFrame, changes: DataFrame, floor: date = FLOOR) -> DataFrame:
    """Sunday rows of sales-led, not excluded, self-parent accounts."""
    d = F.col("report_dt")
    sundays = panel.filter(
        (d >= F.lit(floor))
        & (F.col("sales_channel") == "SALES_LED")
        & ~F.col("exclusion_flag")
        & _self_parent()
        & (d == week_close_before(d))
    )
    churned = churn_dates(panel).select("account_id", "churn_date", "churn_close_week")
    down = downgrade_weeks(changes, floor).alias("g")
    c = sundays.select(
        F.col("effective_account_id").alias("account_id"),
        d.alias("date"),
        d.alias("close_week"),
        "term_start",
        "term_end",
        "program",
        "renewal_dt",
        "act_acr",
        "is_data_plus",
        "is_savings_rollover",
    ).join(churned, "account_id", "left").alias("c")
    joined = c.join(
        down,
        (F.col("c.account_id") == F.col("g.account_id"))
        & (F.col("g.downgrade_close_week") >= F.col("c.close_week")),
        "left",
    )
    never, open_end = F.lit(OPEN_END), F.lit(OPEN_END)
    to_end = month_diff("date", "term_end")
    to_renewal = days_between("date", "renewal_dt")
    return joined.select(
        F.col("c.account_id").alias("account_id"),
        "date",
        "close_week",
        F.coalesce("churn_date", never).alias("churn_date"),
        F.coalesce("churn_close_week", never).alias("churn_close_week"),
        F.coalesce("downgrade_close_week", never).alias("downgrade_close_week"),
        F.when((F.col("term_end") == open_end) | (to_end >= 60), 60).otherwise(to_end).alias("months_until_term_end"),
        month_diff("term_start", "date").alias("months_since_term_start"),
        "program",
        F.when((F.col("renewal_dt") == open_end) | (to_renewal > 1100), 1200)
        .otherwise(to_renewal)
        .alias("days_to_renewal"),
        F.coalesce("act_acr", F.lit(0.0)).alias("act_acr"),
        flag01("is_data_plus").alias("is_data_plus"),
        flag01("is_savings_rollover").alias("is_savings_rollover"),
    )


# -- weekly sources ---------------------------------------------------------------------


def _billed_account() -> Column:
    return F.coalesce("primary_account_id", "fallback_account_id").alias("account_id")


def weekly_capabilities(consumption: DataFrame, floor: date = FLOOR) -> DataFrame:
    """Distinct capabilities per account and week."""
    return (
        consumption.filter(F.col("usage_date") >= F.lit(floor))
        .select(_billed_account(), week_close_after("usage_date").alias("close_week"), "capability")
        .groupBy(*KEY)
        .agg(F.count_distinct("capability").alias("weekly_prod_caps_count"))
    )


def weekly_active_users(usage: DataFrame, panel: DataFrame, floor: date = FLOOR) -> DataFrame:
    """Distinct billed users per account and week, on days the account is eligible.

    Usage is reduced to users per day before the eligibility semi join.
    """
    users = (
        usage.filter(
            (F.col("date") >= F.lit(floor))
            & F.col("daily_active")
            & ~F.lower("metric").contains("unbilled")
        )
        .select("account_id", "date", F.concat("user_id", "datacentre").alias("user"))
        .dropDuplicates()
    )
    eligible = panel.filter(
        F.col("paid_account_flag")
        & (F.col("is_paid_users_eligible") | F.col("monetize_type").isNotNull())
    ).select("account_id", F.col("report_dt").alias("date"))
    return (
        users.join(eligible, ["account_id", "date"], "left_semi")
        .groupBy("account_id", week_close_after("date").alias("close_week"))
        .agg(F.count_distinct("user").alias("wau"))
    )


def _sunday_rows(panel: DataFrame) -> DataFrame:
    return panel.filter(_self_parent() & (F.col("report_dt") == week_close_after("report_dt")))


def weekly_run_rate(panel: DataFrame) -> DataFrame:
    return (
        _sunday_rows(panel)
        .groupBy(F.col("effective_account_id").alias("account_id"), F.col("report_dt").alias("close_week"))
        .agg(F.max("run_rate").alias("bcm_rr"))
    )


def rolling_consumption(consumption: DataFrame, metric: str = "GigabytesIngested") -> DataFrame:
    """Daily volume with its 7-row and 30-row averages, over partitions that grow in number with the input."""
    daily = (
        consumption.filter(F.col("metric") == metric)
        .groupBy(_billed_account(), F.col("usage_date").alias("report_dt"))
        .agg(F.sum("gb").alias("daily_consumption_gb"))
    )
    return rolling_avg(
        spread(daily, "account_id"),
        ["account_id"],
        "report_dt",
        {
            "rolling_7_day_avg_gb": ("daily_consumption_gb", 7),
            "rolling_30_day_avg_gb": ("daily_consumption_gb", 30),
        },
    )


def weekly_rolling_max(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("account_id", week_close_after("report_dt").alias("close_week")).agg(
        *[F.max(c).alias(c) for c in ("rolling_7_day_avg_gb", "rolling_30_day_avg_gb")]
    )


def capability_family(
    capability: str | Column, extra: Mapping[str, Sequence[str]] | None = None
) -> Column:
    """Family of a capability name; unknown or missing names are 'Unattributed'."""
    c = F.col(capability) if isinstance(capability, str) else capability
    out = F.lit("Unattributed")
    for family, names in CAPABILITY_FAMILIES.items():
        out = F.when(c.isin(*names, *(extra or {}).get(family, ())), family).otherwise(out)
    return out


def weekly_families(
    consumption: DataFrame, floor: date = FLOOR, extra: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Distinct (account, week, capability) with its family."""
    return (
        consumption.filter(F.col("usage_date") >= F.lit(floor))
        .select(_billed_account(), week_close_after("usage_date").alias("close_week"), "capability")
        .dropDuplicates()
        .withColumn("family", capability_family("capability", extra))
    )


def weekly_capability_sets(families: DataFrame) -> DataFrame:
    """Number of capabilities and presence of each family, by one grouping of the distinct rows."""
    flags = [F.max(F.when(F.col("family") == v, 1).otherwise(0)).alias(n) for n, v in FAMILY_FLAGS.items()]
    return families.groupBy(*KEY).agg(F.count("capability").alias("weekly_prod_caps_count"), *flags)


def family_list(families: DataFrame) -> DataFrame:
    return distinct_list(families, KEY, "family", "families")


def family_flags(families: DataFrame) -> DataFrame:
    """One 0/1 column per family. No family name contains another's search text,
    so these equal substring tests on the joined list."""
    return presence_flags(families, KEY, "family", FAMILY_FLAGS)


def weekly_category(panel: DataFrame, column: str, *placeholders: str) -> DataFrame:
    """Lowest label on the Sunday snapshot per account, placeholders to 'NA'."""
    return (
        _sunday_rows(panel)
        .groupBy(F.col("effective_account_id").alias("account_id"), F.col("report_dt").alias("close_week"))
        .agg(F.min(column).alias(column))
        .withColumn(column, or_na(column, *placeholders))
    )


def weekly_snapshot(panel: DataFrame) -> DataFrame:
    """Run rate, temperature and sentiment of the Sunday snapshots, by one grouping."""
    return (
        _sunday_rows(panel)
        .groupBy(F.col("effective_account_id").alias("account_id"), F.col("report_dt").alias("close_week"))
        .agg(F.max("run_rate").alias("bcm_rr"), *[F.min(c).alias(c) for c in PLACEHOLDERS])
        .withColumns({c: or_na(c, *none) for c, none in PLACEHOLDERS.items()})
    )


def weekly_temperature(panel: DataFrame) -> DataFrame:
    return weekly_category(panel, "temperature", *PLACEHOLDERS["temperature"])


def weekly_sentiment(panel: DataFrame) -> DataFrame:
    return weekly_category(panel, "sentiment_rating", *PLACEHOLDERS["sentiment_rating"])


def weekly_flags(
    flags_daily: DataFrame, floor: date = FLOOR, names: Sequence[str] = SUBSCRIPTION_FLAGS
) -> DataFrame:
    """Flags on Sundays after the floor. May hold several rows per week."""
    d = F.col("report_dt")
    return flags_daily.filter((d > F.lit(floor)) & (d == week_close_after(d))).select(
        "account_id", d.alias("close_week"), *names
    )


def weekly_logs(logs: DataFrame) -> DataFrame:
    """Distinct (account, week, volume). May hold several rows per week."""
    return logs.select(
        "account_id",
        F.date_add("week", 6).alias("close_week"),
        (F.col("api_logs_gb") + F.col("app_logs_gb")).alias("apm_logs_gb"),
    ).dropDuplicates()


def competitor_flags(
    regions: Sequence[DataFrame],
    hierarchy: DataFrame,
    floor: date = FLOOR,
    counters: Sequence[str] = COMPETITOR_COUNTERS,
) -> DataFrame:
    """Weekly presence of each competitor on the billing account.

    Regions are combined as a set. The hierarchy join carries no dates, so each
    version of an account counts; weekly sums are taken before it, which leaves
    the same totals with far fewer rows. Set and sums share one shuffle by
    account and week, over partitions that grow in number with the input.
    """
    stacked = reduce(
        lambda a, b: a.unionByName(b), [r.select("account_id", "date", *counters) for r in regions]
    )
    dated = stacked.filter(F.col("date") >= F.lit(floor)).withColumn("close_week", week_close_after("date"))
    weekly = spread(dated, *KEY).dropDuplicates().groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in counters])
    h = hierarchy.select("account_id", "billing_account_id")
    return (
        weekly.join(h, "account_id", "left")
        .groupBy(F.col("billing_account_id").alias("account_id"), "close_week")
        .agg(
            *[
                (F.coalesce(F.sum(c), F.lit(0)) != 0).cast("int").alias(f"is_comp_agent_{c.lower()}")
                for c in counters
            ]
        )
    )


# -- feature sets -------------------------------------------------------------------------


def _ratio_names(value: str, base: str, first: tuple[int, int], *rest: tuple[int, int]):
    """Ratios between lags: the first is named after its later lag, the others after both."""
    pairs = {f"{base}_delta_{first[1]}": first}
    pairs.update({f"{base}_delta_{a}_{b}": (a, b) for a, b in rest})
    return {n: (lag_name(value, a), lag_name(value, b)) for n, (a, b) in pairs.items()}


SHORT_STEPS = ((0, 4), (4, 8), (8, 12))
LONG_STEPS = ((0, 4), (4, 8), (8, 12), (12, 24))

CAPS_RATIOS = _ratio_names("weekly_prod_caps_count", "prod_caps", *SHORT_STEPS)
# The last pair is lag 4 over lag 12, although its name says 8 to 12: kept as the feature is defined.
WAU_RATIOS = {**_ratio_names("wau", "wau", *SHORT_STEPS), "wau_delta_8_12": ("wau_4", "wau_12")}
RUN_RATE_RATIOS = _ratio_names("bcm_rr", "bcm_rr", *LONG_STEPS)
ROLLING_7_RATIOS = _ratio_names("rolling_7_day_avg_gb", "rolling_7_day_avg_gb", *LONG_STEPS)
ROLLING_30_RATIOS = _ratio_names("rolling_30_day_avg_gb", "rolling_30_day_avg_gb", *LONG_STEPS)
# Only the first log ratio has "delta" in its name.
LOGS_RATIOS = {
    n if n == "apm_logs_gb_delta_4" else n.replace("_delta", ""): pair
    for n, pair in _ratio_names("apm_logs_gb", "apm_logs_gb", *LONG_STEPS).items()
}


def lagged(
    spine: DataFrame,
    weekly: DataFrame,
    value: str,
    lags: Sequence[int],
    ratios: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """One numeric feature set: values at lags and ratios between lags."""
    return with_ratios(lag_features(spine, (weekly, {value: lags})), ratios, div0)


def lagged_category(spine: DataFrame, weekly: DataFrame, column: str) -> DataFrame:
    """A label at lags; a missing week reads 'NA'."""
    return _labels(lag_features(spine, (weekly, {column: LONG_LAGS})), column)


def _labels(df: DataFrame, column: str) -> DataFrame:
    names = [lag_name(column, k) for k in LONG_LAGS]
    return df.withColumns({n: F.coalesce(n, F.lit("NA")) for n in names})


def lagged_presence(spine: DataFrame, weeks: Mapping[str, DataFrame]) -> DataFrame:
    """1 where the account was active in the week that many weeks ago, for each named activity."""
    marked = [(w.withColumn(n, F.lit(1)), {n: LONG_LAGS}) for n, w in weeks.items()]
    return _zeros(lag_features(spine, *marked), list(weeks))


def _zeros(df: DataFrame, values: Sequence[str]) -> DataFrame:
    names = [lag_name(v, k) for v in values for k in LONG_LAGS]
    return df.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def with_flags(spine: DataFrame, flags: DataFrame, names: Sequence[str] = SUBSCRIPTION_FLAGS) -> DataFrame:
    return _flags01(lag_lists(spine, [], [(flags, names, (0,))]), names)


def _flags01(df: DataFrame, names: Sequence[str] = SUBSCRIPTION_FLAGS) -> DataFrame:
    return df.withColumns({n: flag01(n) for n in names})


def with_logs(spine: DataFrame, logs: DataFrame) -> DataFrame:
    return _log_ratios(lag_lists(spine, [], [(logs, ("apm_logs_gb",), LONG_LAGS)]))


def _log_ratios(df: DataFrame) -> DataFrame:
    """Ratios use the values as found, the value columns read 0 where missing."""
    names = [lag_name("apm_logs_gb", k) for k in LONG_LAGS]
    return with_ratios(df, LOGS_RATIOS, div0).withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})


def competitor_names(counters: Sequence[str]) -> list[str]:
    return [f"is_comp_agent_{c.lower()}" for c in counters]


def with_competitors(
    spine: DataFrame, flags: DataFrame, counters: Sequence[str] = COMPETITOR_COUNTERS
) -> DataFrame:
    names = competitor_names(counters)
    return _competitor_count(lag_features(spine, (flags, dict.fromkeys(names, (0,)))), names)


def _competitor_count(df: DataFrame, names: Sequence[str]) -> DataFrame:
    filled = df.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    return filled.withColumn("weekly_comps_count", reduce(lambda a, b: a + b, [F.col(n) for n in names]))


@dataclass(frozen=True)
class ChurnSources:
    """Logical inputs of the churn features."""

    panel: DataFrame
    changes: DataFrame
    capability_consumption: DataFrame
    feature_usage: DataFrame
    consumption: DataFrame
    flags_daily: DataFrame
    hierarchy: DataFrame
    activity_a: DataFrame
    activity_b: DataFrame
    logs: DataFrame
    competitor_regions: Sequence[DataFrame]
    counters: Sequence[str]
    #: Further capability names by family, such as those that carry a brand.
    extra_capabilities: Mapping[str, Sequence[str]] | None = None


def churn_features(s: ChurnSources, floor: date = FLOOR) -> DataFrame:
    """All feature sets on the spine, in one lag pass: one shuffle by account, no join.

    Sources of one origin are grouped once. Those that may repeat a week (flags, logs) pass as lists and are
    unfolded at the end, where they fan out as joins do.
    """
    spine = weekly_spine(s.panel, s.changes, floor)
    families = weekly_families(s.capability_consumption, floor, s.extra_capabilities)
    names = competitor_names(s.counters)
    presence = {
        "is_change_tracking": weekly_presence(s.activity_a, s.hierarchy),
        "is_advance_query": weekly_presence(s.activity_b, s.hierarchy),
    }
    singles = [
        (
            weekly_capability_sets(families),
            {"weekly_prod_caps_count": SHORT_LAGS, **dict.fromkeys(FAMILY_FLAGS, (0,))},
        ),
        (weekly_active_users(s.feature_usage, s.panel, floor), {"wau": SHORT_LAGS}),
        (weekly_snapshot(s.panel), dict.fromkeys(("bcm_rr", *PLACEHOLDERS), LONG_LAGS)),
        (
            weekly_rolling_max(rolling_consumption(s.consumption)),
            {"rolling_7_day_avg_gb": LONG_LAGS, "rolling_30_day_avg_gb": LONG_LAGS},
        ),
        (
            competitor_flags(s.competitor_regions, s.hierarchy, floor, s.counters),
            dict.fromkeys(names, (0,)),
        ),
        *[(weeks.withColumn(n, F.lit(1)), {n: LONG_LAGS}) for n, weeks in presence.items()],
    ]
    repeating = [
        (weekly_flags(s.flags_daily, floor), SUBSCRIPTION_FLAGS, (0,)),
        (weekly_logs(s.logs), ("apm_logs_gb",), LONG_LAGS),
    ]
    out = lag_lists(spine, singles, repeating)
    out = _log_ratios(_competitor_count(_flags01(out), names))
    ratios = [CAPS_RATIOS, WAU_RATIOS, RUN_RATE_RATIOS, ROLLING_7_RATIOS, ROLLING_30_RATIOS]
    out = with_ratios(out, {k: v for r in ratios for k, v in r.items()}, div0)
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in FAMILY_FLAGS})
    out = _labels(_labels(out, "temperature"), "sentiment_rating")
    return _zeros(out, list(presence))


def latest_week(features: DataFrame) -> DataFrame:
    """Rows of the newest closing week."""
    return latest_slice(features, "close_week")
