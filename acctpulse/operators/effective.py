"""Joins against an effective-dated dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.functions import week_close_after


def weekly_presence(activity: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Distinct (billing account, closing Sunday) with any activity.

    ``activity``: account_id, date. ``hierarchy``: account_id,
    billing_account_id, eff_start, eff_end; a version counts when its interval
    overlaps the week, so a week that straddles a change yields both. The match
    depends on (account, week) only, so activity is reduced to that grain
    before the join.
    """
    weeks = (
        activity.select("account_id", week_close_after("date").alias("usage_week")).dropDuplicates()
    )
    a, h = weeks.alias("a"), hierarchy.alias("h")
    overlap = (
        (F.col("a.account_id") == F.col("h.account_id"))
        & (F.col("h.eff_start") <= F.col("a.usage_week"))
        & (F.col("h.eff_end") >= F.date_sub("a.usage_week", 6))
    )
    return (
        a.join(h, overlap, "left")
        .select(F.col("h.billing_account_id").alias("account_id"), F.col("a.usage_week").alias("close_week"))
        .dropDuplicates()
    )
