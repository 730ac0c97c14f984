"""Account segments, null profile, imputation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acctpulse.functions import month_diff
from acctpulse.operators.quantiles import exact_quantiles
from acctpulse.session import materialize

# Program, early segment, late segment. Early: at most 6 months old.
PLANS = (
    ("Volume Plan", "Early Volume Plan", "Late Volume Plan"),
    ("Savings Plan", "Early Savings Plan", "Late Savings Plan"),
)
SEGMENTS = (
    "Early Volume Plan",
    "Early Savings Plan",
    "Late Volume Plan",
    "Late Savings Plan",
    "PAYG",
)

# Metrics of the statistical analysis.
MODEL_METRICS = (
    "user_activation_percentage",
    "product_stickiness_ratio",
    "user_stickiness_ratio",
    "product_utilization_rate",
    "engagement_score",
    "open_tickets",
    "avg_csat_score",
    "pct_p1_cases",
    "pct_p1p2_cases",
    "resolution_rate",
    "churn_risk_score",
    "sentiment_score",
    "renewal_urgency_months",
    "mthly_fttr_50",
    "revenue_growth",
    "overage_score",
    "contract_length_score",
)
TARGET = "pct_m_plus_6_bcm"


def metric_names(score_names: Sequence[str], suffix: str = "_HSCORE") -> list[str]:
    """Raw metric names of the score names that carry the suffix."""
    return [n.removesuffix(suffix) for n in score_names if n.endswith(suffix)]


def account_segments(panel: DataFrame, as_of: date) -> DataFrame:
    """Panel rows of the five analysed segments, with account age in months.

    The age counts from the first term start of the account and name, over all
    their rows; without an account or name it is unknown.
    """
    named = F.col("account_id").isNotNull() & F.col("account_name").isNotNull()
    first = F.min("term_start").over(Window.partitionBy("account_id", "account_name"))
    aged = panel.withColumn("min_sub_date", F.when(named, first)).withColumn(
        "account_age_mths", month_diff("min_sub_date", F.lit(as_of))
    )
    program, age = F.col("latest_program"), F.col("account_age_mths")
    segment = F.when(program == "PAYG", "PAYG").otherwise("Others")
    for plan, early, late in PLANS:
        segment = (
            F.when((age <= 6) & (program == plan), early).when((age > 6) & (program == plan), late).otherwise(segment)
        )
    return (
        aged.withColumn("segment_name", segment)
        .filter(F.col("segment_name").isin(*SEGMENTS))
        .drop("min_sub_date")
    )


def null_profile(df: DataFrame, columns: Sequence[str], segment: str = "segment_name") -> DataFrame:
    """Percent NULL per column, one row per segment."""
    return df.groupBy(segment).agg(
        *[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in columns if c != segment]
    )


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to numbers; what cannot be read as a number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def segment_medians(df: DataFrame, columns: Sequence[str], segment: str = "segment_name") -> DataFrame:
    """One row per segment with the exact median of each column."""
    q = exact_quantiles(df, [segment], columns, [0.5])
    return q.groupBy(segment).agg(
        *[F.max(F.when(F.col("metric") == c, F.col("q"))).alias(c) for c in columns]
    )


def impute_segment_median(
    df: DataFrame, columns: Sequence[str], segment: str = "segment_name"
) -> DataFrame:
    """Fill NULLs with the segment median; a column NULL throughout a segment stays NULL.

    The medians are written before the join: with their size known, the few
    rows are broadcast and the panel is not shuffled by segment.
    """
    medians = materialize(segment_medians(df, columns, segment), "segment_medians")
    m = medians.select(F.col(segment).alias("_seg"), *[F.col(c).alias(f"_med_{c}") for c in columns])
    joined = df.join(m, F.col(segment) == F.col("_seg"), "left").drop("_seg")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in columns}
    return joined.withColumns(filled).drop(*[f"_med_{c}" for c in columns])


def complete_cases(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    return df.dropna(subset=[*columns, target])


def segment_account_count(df: DataFrame, segment: str = "segment_name") -> DataFrame:
    return df.groupBy(segment).agg(F.count_distinct("account_id").alias("accounts"))
