"""Top row per group and newest-slice filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_row(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """First row of each group.

    Spark plans ``row_number() = 1`` with a per-task group limit before the
    shuffle, so a hot group sends one row per input task. ``order`` should
    break every tie.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def newest(df: DataFrame, column: str) -> Column:
    """The largest value of a column, as a scalar subquery."""
    return df.select(F.max(column)).scalar()


def month_end_or(df: DataFrame, day: str, other: Column) -> DataFrame:
    """Rows on a month end, or on the one other date given."""
    d = F.col(day)
    return df.filter((d == F.last_day(d)) | (d == other))


def latest_slice(df: DataFrame, column: str) -> DataFrame:
    """Rows at the newest value of ``column``."""
    return df.filter(F.col(column) == newest(df, column))
