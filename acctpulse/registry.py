"""Registered analyses: name -> callable(spark, directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.operators.moments import pair_moments
from acctpulse.operators.effective import weekly_presence
from acctpulse.operators.rolling import trailing_median
from acctpulse.plans import billing, churn, finance, health, models, panel, segments, support, usage
from acctpulse.primitives import PRIMITIVES
from acctpulse.session import materialize
from acctpulse.sources.inputs import Inputs

AS_OF = date(2001, 8, 1)
# The given orders span 80 months; a wider horizon keeps every row in.
MONTHS = 90
FLOOR = date(1995, 1, 1)
SCORE_FROM, SCORE_TO = date(1996, 1, 1), date(2000, 12, 31)
FEATURES = ("f_urgent", "f_high", "f_large", "f_medium", "f_low")
COUNTERS = ("comp_a", "comp_b", "comp_c")

Query = Callable[[SparkSession, str], DataFrame]
ANALYSES: dict[str, Query] = {}


def analysis(name: str):
    """Registers a function of the logical inputs."""

    def add(build: Callable[[Inputs], DataFrame]):
        ANALYSES[name] = lambda spark, directory: build(Inputs(spark, directory))
        return build

    return add


# -- account panel --------------------------------------------------------------------------


@analysis("trailing_median")
def _(i):
    return usage.trailing_user_median(i.account_daily(), AS_OF, months=MONTHS)


@analysis("trailing_median_daily")
def _(i):
    rows = i.account_day_gaps().select(
        "account_id", "report_dt", usage.total_users().alias("total_users")
    )
    return trailing_median(rows, "account_id", "report_dt", "total_users", 60, "rolling_60_day_median")


@analysis("user_activation")
def _(i):
    return usage.user_activation(i.account_daily(), AS_OF, MONTHS).select(
        "account_id",
        "report_dt",
        "dau_r7d",
        "committed_users",
        "rolling_60_day_median",
        "denom_users",
        "user_activation_percentage",
    )


@analysis("panel_enrichment")
def _(i):
    return usage.panel_enrichment(i.account_daily(), AS_OF, MONTHS).select(
        "account_id",
        "report_dt",
        *[c for c in usage.enriched_columns()],
        *usage.LATEST,
    )


@analysis("product_stickiness")
def _(i):
    return usage.product_stickiness(i.feature_flags_monthly(), FEATURES, AS_OF, MONTHS)


@analysis("capability_reach")
def _(i):
    return usage.capability_reach(i.feature_usage_daily(), AS_OF, MONTHS)


@analysis("capability_threshold")
def _(i):
    return usage.capability_threshold(usage.capability_reach(i.feature_usage_daily(), AS_OF, MONTHS))


def _daily(i):
    return usage.daily_active_usage(
        i.feature_usage_daily(), i.account_flags_daily(), i.account_metrics_daily(), AS_OF, MONTHS
    )


ANALYSES["daily_active_usage"] = lambda spark, d: _daily(Inputs(spark, d))


@analysis("stickiness_utilization")
def _(i):
    # The fact is read twice: once for the reach, a small table, and once for the daily counts.
    used = i.feature_usage_daily()
    reach = materialize(usage.capability_reach(used, AS_OF, MONTHS), "capability_reach")
    daily = usage.daily_active_usage(
        used, i.account_flags_daily(), i.account_metrics_daily(), AS_OF, MONTHS, reach
    )
    return usage.stickiness_utilization(i.account_daily(), daily, usage.capability_threshold(reach), AS_OF, MONTHS)


@analysis("term_to_date")
def _(i):
    return finance.term_to_date(i.account_daily(), AS_OF)


@analysis("term_to_date_updated")
def _(i):
    return finance.term_to_date_updated(i.account_daily(), AS_OF, MONTHS)


@analysis("contract_terms")
def _(i):
    return finance.contract_terms(i.contract_terms()).drop("program")


@analysis("acr_spread")
def _(i):
    p = i.account_daily()
    to_date = finance.term_to_date_updated(p, AS_OF, MONTHS).select("account_id", "report_dt", "ctd_updated")
    rows = p.select("account_id", "report_dt", "acr", "term_start", "term_end").join(
        to_date, ["account_id", "report_dt"]
    )
    return finance.acr_spread(rows).select(
        "account_id", "report_dt", "total_acr", "day_wise_acr", "month_wise_acr", "amount_left"
    )


@analysis("overage")
def _(i):
    return finance.overage(i.account_daily()).select(
        "account_id", "report_dt", "overages", F.round("overage_score", 9).alias("overage_score")
    )


@analysis("renewal_countdown")
def _(i):
    return i.account_daily().select(
        "account_id", "report_dt", *[c.alias(n) for n, c in finance.renewal_columns(AS_OF).items()]
    )


@analysis("bcm_per_day")
def _(i):
    return i.account_daily().select(
        "account_id", "report_dt", *[c.alias(n) for n, c in finance.amount_columns().items()]
    )


@analysis("first_report_date")
def _(i):
    return finance.first_report_date(i.account_daily())


@analysis("forward_bcm")
def _(i):
    return finance.forward_bcm(i.account_month_end(), AS_OF).drop("amount_month")


@analysis("month_numbering")
def _(i):
    rows = i.account_daily().select("account_id", "report_dt", "term_start")
    return finance.month_numbering(rows)


@analysis("revenue_growth")
def _(i):
    return finance.revenue_growth(finance.bcm_per_day(i.account_month_end())).select(
        "account_id", "report_dt", "bcm", "l3m_bcm", "l3m_bcm_days", "revenue_growth"
    )


@analysis("growth_score")
def _(i):
    grown = finance.revenue_growth(finance.bcm_per_day(i.account_month_end()))
    first = finance.first_report_date(i.account_daily())
    return finance.growth_score(grown.join(first, "account_id", "left")).select(
        "account_id", "report_dt", "revenue_growth", "revenue_growth_score"
    )


@analysis("burn_down")
def _(i):
    return finance.financial_metrics(i.account_daily(), AS_OF, MONTHS).select(
        "account_id",
        "report_dt",
        "day_temperature",
        "month_temperature",
        "days_to_deplete",
        "months_to_deplete",
        "renewal_urgency_days",
        "renewal_urgency_months",
    )


@analysis("financial_metrics")
def _(i):
    return finance.financial_metrics(i.account_daily(), AS_OF, MONTHS).select(
        "account_id",
        "report_dt",
        "bcm",
        "l3m_bcm",
        "total_acr",
        "amount_left",
        "overages",
        F.round("overage_score", 9).alias("overage_score"),
        "revenue_growth",
        "revenue_growth_score",
        "contract_length_mths",
        "contract_length_score",
        "contract_yrs",
        "mths_till_date",
        "target_m_plus_6_bcm",
        "target_m_plus_12_bcm",
        "pct_m_plus_6_bcm",
        "pct_m_plus_12_bcm",
        "consumed_month_number",
        "first_report_date",
    )


@analysis("case_priority")
def _(i):
    return support.case_priority(i.support_cases(), i.case_history(), FLOOR)


@analysis("case_resolution")
def _(i):
    return support.case_resolution(i.support_cases(), FLOOR)


@analysis("case_satisfaction")
def _(i):
    return support.case_satisfaction(i.support_cases(), FLOOR)


@analysis("first_response_time")
def _(i):
    return support.first_response_time(i.support_cases(), AS_OF, FLOOR)


@analysis("support_metrics")
def _(i):
    return support.support_metrics(i.support_cases(), i.case_history(), AS_OF, FLOOR)


def _live(i):
    return billing.live_invoices(i.invoices(), i.invoice_customers(), AS_OF, MONTHS)


@analysis("open_invoice_exposure")
def _(i):
    return billing.open_invoice_exposure(_live(i))


@analysis("latest_invoice")
def _(i):
    return billing.latest_invoice(_live(i))


@analysis("latest_weekly_score")
def _(i):
    return billing.latest_weekly_score(
        i.score_weekly(), ["churn_risk_score", "sentiment_score", "engagement_score"]
    )


@analysis("competitor_monthly")
def _(i):
    return billing.competitor_monthly([i.competitors("O"), i.competitors("F")], COUNTERS)


def account_panel(i: Inputs) -> DataFrame:
    i = i.dealt_by_account()
    return panel.account_360(
        panel.PanelSources(
            panel=i.account_daily(),
            feature_flags=i.feature_flags_monthly(),
            features=FEATURES,
            feature_usage=i.feature_usage_daily(),
            account_flags=i.account_flags_daily(),
            account_metrics=i.account_metrics_daily(),
            cases=i.support_cases(),
            case_history=i.case_history(),
            risk_weekly=i.score_weekly(),
            sentiment_weekly=i.score_weekly(),
            invoices=i.invoices(),
            invoice_customers=i.invoice_customers(),
            competitor_regions=[i.competitors("O"), i.competitors("F")],
            counters=COUNTERS,
        ),
        AS_OF,
        MONTHS,
        FLOOR,
        i.parts,
    )


ANALYSES["account_360"] = lambda spark, d: account_panel(Inputs(spark, d))

# -- health scores ------------------------------------------------------------------------------


@analysis("metrics_long")
def _(i):
    return health.metrics_long(i.metric_panel())


@analysis("metric_category")
def _(i):
    return health.metric_category(health.metrics_long(i.metric_panel()))


@analysis("metric_percentiles")
def _(i):
    return health.metric_percentiles(i.metric_panel(), SCORE_FROM, SCORE_TO)


def _scores(i, names, rounded=False):
    rows = i.metric_panel()
    marks = health.metric_percentiles(rows, SCORE_FROM, SCORE_TO)
    scores = health.metric_scores(rows, marks, rounded)
    return scores.select(*health.KEY, *[health.score_name(m) for m in names])


@analysis("score_direct")
def _(i):
    return _scores(i, health.DIRECT)


@analysis("score_inverse")
def _(i):
    return _scores(i, health.INVERSE)


@analysis("score_linear")
def _(i):
    return _scores(i, [m for m in health.METRICS if m not in health.RANKED])


@analysis("score_round")
def _(i):
    return _scores(i, health.METRICS, rounded=True)


@analysis("category_score")
def _(i):
    scores = _scores(i, health.METRICS, rounded=True)
    return health.category_scores(scores).select(*health.KEY, *health.CATEGORY_COLUMNS.values())


@analysis("scores_long")
def _(i):
    return health.scores_long(health.category_scores(_scores(i, health.METRICS, rounded=True)))


@analysis("health_score")
def _(i):
    return health.health_score(i.metric_panel(), SCORE_FROM, SCORE_TO)


@analysis("score_lookup")
def _(i):
    return health.score_lookup(health.health_score(i.metric_panel(), SCORE_FROM, SCORE_TO), 17)


@analysis("health_score_360")
def _(i):
    """The whole chain: account panel, written once, then scored."""
    return health.health_score(materialize(account_panel(i), "account_panel"), SCORE_FROM, SCORE_TO)


# -- churn features -------------------------------------------------------------------------------


def _spine_keys(i):
    return churn.weekly_spine(i.account_daily(), i.acr_change(), FLOOR).select(*churn.KEY)


@analysis("churn_date")
def _(i):
    return churn.churn_dates(i.account_daily())


@analysis("downgrade_week")
def _(i):
    return churn.downgrade_weeks(i.acr_change(), FLOOR)


@analysis("weekly_spine")
def _(i):
    return churn.weekly_spine(i.account_daily(), i.acr_change(), FLOOR)


@analysis("weekly_capabilities")
def _(i):
    return churn.weekly_capabilities(i.capability_consumption_daily(), FLOOR)


@analysis("weekly_active_users")
def _(i):
    return churn.weekly_active_users(i.feature_usage_daily(), i.account_daily(), FLOOR)


@analysis("weekly_run_rate")
def _(i):
    return churn.weekly_run_rate(i.account_daily())


@analysis("rolling_consumption")
def _(i):
    return churn.rolling_consumption(i.consumption_daily())


@analysis("weekly_rolling_max")
def _(i):
    return churn.weekly_rolling_max(churn.rolling_consumption(i.consumption_daily()))


@analysis("lag_capabilities")
def _(i):
    weekly = churn.weekly_capabilities(i.capability_consumption_daily(), FLOOR)
    return churn.lagged(
        _spine_keys(i), weekly, "weekly_prod_caps_count", churn.SHORT_LAGS, churn.CAPS_RATIOS
    )


@analysis("lag_active_users")
def _(i):
    weekly = churn.weekly_active_users(i.feature_usage_daily(), i.account_daily(), FLOOR)
    return churn.lagged(_spine_keys(i), weekly, "wau", churn.SHORT_LAGS, churn.WAU_RATIOS)


@analysis("lag_run_rate")
def _(i):
    weekly = churn.weekly_run_rate(i.account_daily())
    return churn.lagged(_spine_keys(i), weekly, "bcm_rr", churn.LONG_LAGS, churn.RUN_RATE_RATIOS)


@analysis("lag_features")
def _(i):
    """Both rolling volumes at all lags, from one pass."""
    weekly = churn.weekly_rolling_max(churn.rolling_consumption(i.consumption_daily()))
    values = {"rolling_7_day_avg_gb": churn.LONG_LAGS, "rolling_30_day_avg_gb": churn.LONG_LAGS}
    out = churn.lag_features(_spine_keys(i), (weekly, values))
    return churn.with_ratios(out, {**churn.ROLLING_7_RATIOS, **churn.ROLLING_30_RATIOS}, churn.div0)


@analysis("capability_family")
def _(i):
    return churn.weekly_families(i.capability_consumption_daily(), FLOOR)


@analysis("family_list")
def _(i):
    return churn.family_list(churn.weekly_families(i.capability_consumption_daily(), FLOOR))


@analysis("family_flags")
def _(i):
    flags = churn.family_flags(churn.weekly_families(i.capability_consumption_daily(), FLOOR))
    out = _spine_keys(i).join(flags, churn.KEY, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in churn.FAMILY_FLAGS})


@analysis("weekly_category_snapshot")
def _(i):
    return churn.weekly_sentiment(i.account_daily())


@analysis("lag_temperature")
def _(i):
    return churn.lagged_category(_spine_keys(i), churn.weekly_temperature(i.account_daily()), "temperature")


@analysis("weekly_flags")
def _(i):
    return churn.with_flags(_spine_keys(i), churn.weekly_flags(i.subscription_flags_daily(), FLOOR))


def _presence(i):
    hierarchy = i.account_hierarchy()
    sources = {"is_change_tracking": i.activity("O"), "is_advance_query": i.activity("F")}
    return {n: weekly_presence(a, hierarchy) for n, a in sources.items()}


@analysis("scd_presence")
def _(i):
    marked = [w.withColumn("activity", F.lit(n)) for n, w in _presence(i).items()]
    return marked[0].unionByName(marked[1])


@analysis("lag_presence")
def _(i):
    return churn.lagged_presence(_spine_keys(i), _presence(i))


@analysis("weekly_log_volume")
def _(i):
    return churn.with_logs(_spine_keys(i), churn.weekly_logs(i.logs_weekly()))


def _competitor_flags(i):
    return churn.competitor_flags(
        [i.competitors("O"), i.competitors("F")], i.account_hierarchy(), FLOOR, COUNTERS
    )


@analysis("competitor_weekly")
def _(i):
    return _competitor_flags(i)


@analysis("competitor_spine")
def _(i):
    return churn.with_competitors(_spine_keys(i), _competitor_flags(i), COUNTERS)


def churn_sources(i: Inputs) -> churn.ChurnSources:
    return churn.ChurnSources(
        panel=materialize(i.account_daily(), "account_daily"),
        changes=i.acr_change(),
        capability_consumption=i.capability_consumption_daily(),
        feature_usage=i.feature_usage_daily(),
        consumption=i.consumption_daily(),
        flags_daily=i.subscription_flags_daily(),
        hierarchy=i.account_hierarchy(),
        activity_a=i.activity("O"),
        activity_b=i.activity("F"),
        logs=i.logs_weekly(),
        competitor_regions=[i.competitors("O"), i.competitors("F")],
        counters=COUNTERS,
    )


def churn_table(i: Inputs) -> DataFrame:
    return churn.churn_features(churn_sources(i), FLOOR)


ANALYSES["churn_features"] = lambda spark, d: churn_table(Inputs(spark, d))


@analysis("latest_week_slice")
def _(i):
    return churn.latest_week(materialize(churn_table(i), "churn_features"))


# -- segments and models ------------------------------------------------------------------------------

PROFILE = ("account_id", "account_name", "report_dt", *segments.MODEL_METRICS, segments.TARGET)


def _segments(i):
    return segments.account_segments(i.metric_panel(), AS_OF)


def _imputed(i):
    return segments.impute_segment_median(_segments(i), segments.MODEL_METRICS)


@analysis("account_segments")
def _(i):
    return _segments(i)


@analysis("null_profile")
def _(i):
    return segments.null_profile(_segments(i), PROFILE)


@analysis("coerce_numeric")
def _(i):
    rows = i.table("orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("priority_number"),
        F.substring("o_orderpriority", 1, 1).alias("priority_digit"),
    )
    return segments.coerce_numeric(rows, ["priority_number", "priority_digit"])


@analysis("segment_medians")
def _(i):
    return segments.segment_medians(_segments(i), segments.MODEL_METRICS)


@analysis("impute_segment_median")
def _(i):
    return _imputed(i).select(
        "account_id", "report_dt", "segment_name", segments.TARGET, *segments.MODEL_METRICS
    )


@analysis("complete_cases")
def _(i):
    wanted = ["user_activation_percentage", "mthly_fttr_50", "open_tickets"]
    return segments.complete_cases(_segments(i), wanted, segments.TARGET).select(
        "account_id", "report_dt", "segment_name"
    )


@analysis("segment_account_count")
def _(i):
    return segments.segment_account_count(_segments(i))


@analysis("segment_ols")
def _(i):
    fit = models.segment_ols(i.model_rows(), ["quantity", "tax_pct"], "target")
    return fit.select(
        "segment_name",
        "term",
        F.round("coefficient", 4).alias("coefficient"),
        F.round("r_squared", 8).alias("r_squared"),
        "n",
    )


@analysis("segment_ols_metrics")
def _(i):
    return models.segment_ols(_imputed(i), segments.MODEL_METRICS, segments.TARGET)


@analysis("segment_correlation")
def _(i):
    return models.segment_correlation(_imputed(i), segments.MODEL_METRICS).withColumn(
        "corr", F.round("corr", 8)
    )


@analysis("segment_vif")
def _(i):
    return models.segment_vif(i.model_rows().drop("target"), ["quantity", "tax_pct"]).withColumn(
        "vif", F.round("vif", 8)
    )


@analysis("segment_vif_metrics")
def _(i):
    return models.segment_vif(_imputed(i), segments.MODEL_METRICS)


@analysis("pair_moments")
def _(i):
    rows = i.model_rows().dropna(subset=["tax_pct"])
    m = pair_moments(rows, "segment_name", ["quantity", "tax_pct"])
    return m.select(
        "segment_name", "i", "j", "n", *[F.round(c, 6).alias(c) for c in ("mean_i", "mean_j", "cov")]
    )


@analysis("rf_importance")
def _(i):
    return models.rf_importance(_imputed(i), segments.MODEL_METRICS, segments.TARGET)


ANALYSES.update(PRIMITIVES)
