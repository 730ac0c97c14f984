"""Raw panel metrics to 0-100 scores, category scores and one health score."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctpulse.functions import dec0, mean_non_null, percentile_score
from acctpulse.operators.quantiles import exact_quantiles
from acctpulse.operators.reshape import unpivot_keep_nulls

# The scored metrics by category.
CATEGORIES = {
    "Adoption_score": (
        "product_stickiness_ratio",
        "user_stickiness_ratio",
        "user_activation_percentage",
        "product_utilization_rate",
    ),
    "Engagement_score": ("avg_csat_score", "open_tickets", "engagement_score"),
    "Financial_health_score": (
        "revenue_growth",
        "renewal_urgency_months",
        "overage_score",
        "contract_length_score",
        "maximum_days_past_due",
        "sum_total_amount_due",
    ),
    "Risk_score": (
        "pct_p1_cases",
        "pct_p1p2_cases",
        "resolution_rate",
        "mthly_fttr_50",
        "churn_risk_score",
        "sentiment_score",
    ),
}

CATEGORY_COLUMNS = {
    "Adoption_score": "adoption_score_cal",
    "Engagement_score": "engagement_score_cal",
    "Financial_health_score": "financial_health_score_cal",
    "Risk_score": "risk_score_cal",
}

METRICS = tuple(m for members in CATEGORIES.values() for m in members)

# Score of a missing metric, score of a missing percentile.
DIRECT = {
    "user_activation_percentage": (None, 50),
    "product_stickiness_ratio": (None, 50),
    "user_stickiness_ratio": (None, 50),
    "product_utilization_rate": (None, 50),
    "overage_score": (None, 50),
    "resolution_rate": (100, 50),
    "open_tickets": (0, 50),
    "avg_csat_score": (0, 0),
}
INVERSE = {
    "pct_p1_cases": (100, 50),
    "pct_p1p2_cases": (100, 50),
    "mthly_fttr_50": (100, 50),
    "maximum_days_past_due": (100, 50),
    "sum_total_amount_due": (100, 50),
}
RANKED = (*DIRECT, *INVERSE)

KEY = ["account_id", "report_dt"]
# The reporting period the percentiles are taken over.
PERCENTILE_FROM, PERCENTILE_TO = date(2024, 4, 1), date(2025, 3, 31)


def score_name(metric: str) -> str:
    return f"{metric}_hscore"


def metrics_long(panel: DataFrame, ids: Sequence[str] = KEY, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per account, date and metric; missing metrics keep their row."""
    long = unpivot_keep_nulls(panel, ids, metrics, "metric_name", "metric_value")
    return long.withColumn("metric_name", F.upper("metric_name"))


def metric_category(long: DataFrame) -> DataFrame:
    """Adds the category of each metric."""
    category = F.lit(None).cast("string")
    for name, members in CATEGORIES.items():
        category = F.when(F.col("metric_name").isin(*[m.upper() for m in members]), name).otherwise(category)
    return long.withColumn("score_type", category)


def metric_percentiles(
    panel: DataFrame, start: date = PERCENTILE_FROM, end: date = PERCENTILE_TO
) -> DataFrame:
    """One row with p1_<metric> and p99_<metric> over the whole population of the period."""
    rows = panel.filter(F.col("report_dt").between(F.lit(start), F.lit(end)))
    q = exact_quantiles(rows, [], RANKED, [0.01, 0.99])

    def pick(metric: str, p: float) -> Column:
        return F.max(F.when((F.col("metric") == metric) & (F.col("p") == p), F.col("q")))

    # A global aggregate always has its one row, even when no metric has a value.
    return q.agg(
        *[pick(m, p).alias(f"p{int(p * 100)}_{m}") for m in RANKED for p in (0.01, 0.99)]
    )


def score_columns() -> dict[str, Column]:
    linear = {
        "churn_risk_score": (1 - F.col("churn_risk_score").cast("double")) * 100,
        "sentiment_score": F.col("sentiment_score").cast("double") * 100,
        "engagement_score": F.col("engagement_score").cast("double") * 100,
        # these three pass through as they are
        "renewal_urgency_months": F.col("renewal_urgency_months").cast("double"),
        "revenue_growth": F.col("revenue_growth_score").cast("double"),
        "contract_length_score": F.col("contract_length_score").cast("double"),
    }
    ranked = {
        m: percentile_score(
            m, f"p1_{m}", f"p99_{m}", if_null=null, if_no_range=no_range, inverse=m in INVERSE
        )
        for m, (null, no_range) in {**DIRECT, **INVERSE}.items()
    }
    both = {**linear, **ranked}
    return {score_name(m): both[m] for m in METRICS}


def with_percentiles(panel: DataFrame, percentiles: DataFrame) -> DataFrame:
    """The one percentile row as columns, through a scalar subquery: scoring stays row-local."""
    row = percentiles.select(F.struct("*")).scalar()
    return panel.select("*", row.alias("_marks")).select("*", "_marks.*").drop("_marks")


def metric_scores(panel: DataFrame, percentiles: DataFrame, rounded: bool = True) -> DataFrame:
    """One score per metric, rounded to whole numbers."""
    scores = score_columns()
    return with_percentiles(panel, percentiles).select(
        *KEY, *[(dec0(c) if rounded else c).alias(name) for name, c in scores.items()]
    )


def category_scores(scores: DataFrame) -> DataFrame:
    """Mean of the present scores per category; 0 when none is present."""
    return scores.withColumns(
        {
            CATEGORY_COLUMNS[name]: mean_non_null([score_name(m) for m in members])
            for name, members in CATEGORIES.items()
        }
    )


def scores_long(categories: DataFrame) -> DataFrame:
    """One row per account, date and score, with the category scores alongside."""
    ids = [*KEY, *CATEGORY_COLUMNS.values()]
    long = unpivot_keep_nulls(
        categories, ids, [score_name(m) for m in METRICS], "metric_name_score", "metric_score"
    )
    return long.withColumn("metric_name_score", F.upper("metric_name_score"))


def health_score(
    panel: DataFrame,
    start: date = PERCENTILE_FROM,
    end: date = PERCENTILE_TO,
    ids: Sequence[str] = KEY,
) -> DataFrame:
    """Every metric with its score, the category scores and the overall score.

    Metric and score of one panel row are unpivoted side by side as structs.
    The panel is keyed by account and date, so this equals unpivoting both and
    joining them on account, date and name, without the join.
    """
    percentiles = metric_percentiles(panel, start, end)
    scores = score_columns()
    kept = list(dict.fromkeys([*ids, *KEY]))
    wide = category_scores(
        with_percentiles(panel, percentiles).select(
            *kept, *METRICS, *[dec0(c).alias(n) for n, c in scores.items()]
        )
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(m.upper()).alias("metric_name"),
                F.col(m).alias("metric_value"),
                F.col(score_name(m)).alias("metric_score"),
                F.lit(score_name(m).upper()).alias("metric_name_score"),
            )
            for m in METRICS
        ]
    )
    overall = sum((F.col(c) for c in list(CATEGORY_COLUMNS.values())[1:]), F.col("adoption_score_cal")) / 4
    long = wide.select(*kept, *CATEGORY_COLUMNS.values(), F.inline(pairs))
    return metric_category(long).withColumns({"weights": F.lit(0), "health_score": overall})


def score_lookup(health: DataFrame, account_id) -> DataFrame:
    """Scores of one account."""
    return health.filter(F.col("account_id") == account_id).select(
        *KEY, "metric_name", "metric_score", *CATEGORY_COLUMNS.values(), "health_score"
    )
