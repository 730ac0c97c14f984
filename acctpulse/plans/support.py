"""Account panel: support case measures per account and month."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.functions import minute_diff, month_start, safe_div
from acctpulse.operators.assembly import dealt_join, stack_join

CASE_FLOOR = date(2023, 1, 1)


def first_priorities(cases: DataFrame, history: DataFrame, floor: date = CASE_FLOOR) -> DataFrame:
    """Cases with the old value of their last priority change, else their current priority.

    ``max_by`` merges per task before the shuffle; case ids are unique in
    ``cases``. History rows of one case have distinct times.
    """
    changed = (
        history.filter(F.col("field") == "Priority")
        .groupBy("case_id")
        .agg(F.max_by("old_value", "created_ts").alias("changed_priority"))
    )
    return (
        cases.filter(F.col("created_ts") >= F.lit(floor))
        .join(changed, "case_id", "left")
        .select(
            "case_id",
            "account_id",
            "account_name",
            month_start("created_ts").alias("case_month"),
            F.coalesce("changed_priority", "priority").alias("first_priority"),
        )
    )


def case_priority(cases: DataFrame, history: DataFrame, floor: date = CASE_FLOOR) -> DataFrame:
    """P1 and P1+P2 shares of accounts with more than one assigned case in a month."""
    return priority_shares(first_priorities(cases, history, floor))


def priority_shares(first: DataFrame) -> DataFrame:
    """The shares of ``case_priority`` from ``first_priorities``."""
    p = F.col("first_priority")
    counted = (
        first.groupBy("account_id", "account_name", "case_month")
        .agg(
            F.count_if(p == "P1").alias("cnt_p1"),
            F.count_if(p == "P2").alias("cnt_p2"),
            F.count(p).alias("total_assigned"),
        )
        .filter(F.col("total_assigned") > 1)
    )
    return counted.withColumns(
        {
            "pct_p1_cases": safe_div(F.col("cnt_p1") * F.lit(100.0), F.col("total_assigned")),
            "pct_p1p2_cases": safe_div(
                (F.col("cnt_p1") + F.col("cnt_p2")) * F.lit(100.0), F.col("total_assigned")
            ),
        }
    )


def case_resolution(cases: DataFrame, floor: date = CASE_FLOOR) -> DataFrame:
    """Cases opened per month and the share solved within the same month.

    A case's opening and its same-month solution share account and month, so
    both distinct counts come from the same rows, one per case.
    """
    created, solved = month_start("created_ts"), month_start("solved_ts")
    rows = cases.filter(
        (F.col("created_ts") >= F.lit(floor)) | (F.col("solved_ts") >= F.lit(floor))
    ).select("account_id", created.alias("case_month"), "case_id", (created == solved).alias("same_month"))
    # a case without an account is opened but matches no solved count
    counted = F.col("same_month") & F.col("account_id").isNotNull()
    by_case = rows.groupBy("account_id", "case_month", "case_id").agg(F.max(counted).alias("solved"))
    grouped = by_case.groupBy("account_id", "case_month").agg(
        F.count("case_id").alias("open_tickets"),
        F.count(F.when(F.col("solved"), F.col("case_id"))).alias("solved"),
    )
    return grouped.select(
        "account_id",
        "case_month",
        "open_tickets",
        # no solved case and no opened case read the same as in a left join: NULL
        F.when(F.col("solved") > 0, F.col("solved")).alias("solved_tickets"),
        F.when(F.col("open_tickets") == 0, F.lit(1.0))
        .otherwise(F.coalesce(safe_div(F.col("solved").cast("double"), F.col("open_tickets")), F.lit(0.0)))
        .alias("resolution_rate"),
    )


def case_satisfaction(cases: DataFrame, floor: date = CASE_FLOOR) -> DataFrame:
    return (
        cases.filter((F.col("solved_ts") >= F.lit(floor)) & F.col("csat").isNotNull())
        .groupBy("account_id", "account_name", month_start("solved_ts").alias("solved_month"))
        .agg(F.avg("csat").alias("avg_csat_score"), F.count("case_id").alias("csat_counts"))
    )


def response_hours(cases: DataFrame, as_of: date, floor: date = CASE_FLOOR) -> DataFrame:
    """Hours to first response; unanswered cases run to the day after they were solved, or after today."""
    answered = F.coalesce(
        F.col("first_response_ts").cast("timestamp"),
        F.date_add(F.to_date("solved_ts"), 1).cast("timestamp"),
        F.date_add(F.lit(as_of), 1).cast("timestamp"),
    )
    minutes = minute_diff(F.col("created_ts").cast("timestamp"), answered)
    return (
        cases.filter(F.col("created_ts") >= F.lit(floor))
        .select(
            month_start("created_ts").alias("case_month"),
            "account_id",
            "account_name",
            "case_id",
            (minutes / F.lit(60.0)).alias("fttr_hrs"),
        )
        .filter(F.col("fttr_hrs") >= 0)
    )


def first_response_time(cases: DataFrame, as_of: date, floor: date = CASE_FLOOR) -> DataFrame:
    """Response-time quartiles per month and account name, reported per account id.

    Quartiles pool every account of the same name. Response times are whole
    minutes, so the percentile state of a group holds at most the distinct
    minutes of the period, whatever number of cases it has.
    """
    hours = response_hours(cases, as_of, floor)
    quartiles = hours.groupBy("case_month", "account_name").agg(
        *[
            F.percentile("fttr_hrs", F.lit(p)).alias(f"mthly_fttr_{int(p * 100)}")
            for p in (0.25, 0.5, 0.75)
        ]
    )
    accounts = hours.select("case_month", "account_id", "account_name").dropDuplicates()
    h, q = accounts.alias("h"), quartiles.alias("q")
    return h.join(
        q,
        (F.col("h.case_month") == F.col("q.case_month"))
        & F.col("h.account_name").eqNullSafe(F.col("q.account_name")),
    ).select("h.*", "mthly_fttr_25", "mthly_fttr_50", "mthly_fttr_75")


def support_metrics(
    cases: DataFrame, history: DataFrame, as_of: date, floor: date = CASE_FLOOR, parts: int | None = None
) -> DataFrame:
    """The support branch at account and month.

    With ``parts``, ``cases`` are dealt by account into so many partitions, and so is the result.
    """
    key = ["account_id", "case_month"]
    first = first_priorities(cases, history, floor)
    priority = priority_shares(first.repartition(parts, "account_id") if parts else first)
    priority = priority.select(*key, "pct_p1_cases", "pct_p1p2_cases")
    csat = case_satisfaction(cases, floor).select(
        "account_id", F.col("solved_month").alias("case_month"), "avg_csat_score"
    )
    response = first_response_time(cases, as_of, floor).select(*key, "mthly_fttr_50")
    resolution = case_resolution(cases, floor).select(*key, "resolution_rate", "open_tickets")
    if parts:
        response = response.repartition(parts, "account_id")
        return dealt_join(resolution, key, priority, csat, response, distinct=False)
    return stack_join(resolution, key, priority, csat, response, distinct=False)
