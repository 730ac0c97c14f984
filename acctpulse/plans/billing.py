"""Account panel: invoice exposure, monthly scores, competitor counters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acctpulse.functions import month_start
from acctpulse.operators.latest import top_row
from acctpulse.plans.usage import HORIZON_MONTHS

# Counters of the competitor tables.
COMPETITOR_COUNTERS = (
    "AppDynamics",
    "DataDog",
    "Dynatrace",
    "ElasticAgent",
    "Grafana",
    "LogicMonitor",
    "OpenTelemetry",
    "SignalFX",
    "Splunk",
    "SumoLogic",
    "ZeroAgent",
)


def live_invoices(
    invoices: DataFrame, customers: DataFrame, as_of: date, months: int = HORIZON_MONTHS
) -> DataFrame:
    """Invoices in the horizon whose row and customer are not deleted."""
    kept = invoices.filter(
        F.col("due_dt").isNotNull()
        & (F.col("due_dt") >= F.add_months(F.lit(as_of), -months))
        & ~F.col("deleted")
    ).drop("deleted")
    alive = customers.filter(~F.col("deleted")).select(F.col("customer_id").alias("entity_id"))
    return kept.join(alive, "entity_id")


def open_invoice_exposure(live: DataFrame) -> DataFrame:
    """Open invoices due up to each of an account's invoice months.

    Not every spine month against every earlier invoice: invoices are summed
    per account and month, and the months are accumulated. Only months remain
    to be ordered within an account. Days past due count from the oldest open
    due date; closed invoices count 0.
    """
    is_open = F.col("closed_dt").isNull()
    monthly = live.groupBy("account_id", F.last_day("due_dt").alias("month_end")).agg(
        F.min(F.when(is_open, F.col("due_dt"))).alias("oldest_open"),
        F.sum(F.when(is_open, F.col("amount")).otherwise(0.0)).alias("open_amount"),
        F.count_if(is_open).alias("open_count"),
    )
    upto = (
        Window.partitionBy("account_id")
        .orderBy("month_end")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    past_due = F.datediff("month_end", F.min("oldest_open").over(upto))
    # an invoice without an account matches no spine row
    return monthly.filter(F.col("account_id").isNotNull()).select(
        "account_id",
        "month_end",
        F.coalesce(past_due, F.lit(0)).alias("maximum_days_past_due"),
        F.sum("open_amount").over(upto).alias("sum_total_amount_due"),
        F.sum("open_count").over(upto).alias("number_of_open_invoices"),
    )


def latest_invoice(live: DataFrame) -> DataFrame:
    """Exposure with the month's latest invoice (ties: highest transaction id)."""
    spine = live.select("account_id", F.last_day("due_dt").alias("month_end")).dropDuplicates()
    recent = top_row(
        live.withColumn("month_end", F.last_day("due_dt")),
        ["account_id", "month_end"],
        [F.col("due_dt").desc_nulls_last(), F.col("transaction_id").desc_nulls_last()],
    ).select(
        "account_id",
        "month_end",
        F.col("due_dt").alias("recent_invoice_due_date"),
        F.col("amount").alias("recent_invoice_due_amt"),
        F.col("status").alias("recent_invoice_due_status"),
    )
    key = ["account_id", "month_end"]
    exposure = open_invoice_exposure(live)
    return (
        spine.join(exposure, key, "left")
        .join(recent, key, "left")
        .select(
            "account_id",
            month_start("month_end").alias("invoice_month"),
            *[
                F.coalesce(c, F.lit(0)).alias(c)
                for c in ("maximum_days_past_due", "sum_total_amount_due", "number_of_open_invoices")
            ],
            "recent_invoice_due_date",
            "recent_invoice_due_amt",
            "recent_invoice_due_status",
        )
    )


def latest_weekly_score(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each account's last weekly record of every month."""
    rows = scores.withColumn("score_month", month_start("date"))
    order = [F.col("date").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in columns]]
    return top_row(rows, ["account_id", "score_month"], order).select(
        "account_id", "score_month", *columns
    )


def competitor_monthly(regions: Sequence[DataFrame], counters: Sequence[str] = COMPETITOR_COUNTERS) -> DataFrame:
    """Monthly maximum of each counter over all regions, and their plain sum."""
    stacked = reduce(
        lambda a, b: a.unionByName(b), [r.select("account_id", "date", *counters) for r in regions]
    )
    monthly = stacked.groupBy("account_id", month_start("date").alias("reporting_month")).agg(
        *[F.max(c).alias(c) for c in counters]
    )
    total = reduce(lambda a, b: a + b, [F.col(c) for c in counters])
    return monthly.withColumn("total_competitor_agents", total)
