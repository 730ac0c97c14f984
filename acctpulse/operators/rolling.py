"""Ordered windows per key.

ROWS frames count rows, not days: a missing day is not filled. Callers reduce
their facts to one row per key and day (or month) first, so a window partition
is bounded by the calendar however many raw rows a key has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())


def rolling_avg(
    df: DataFrame, keys: Sequence[str], order: str, outputs: Mapping[str, tuple[str | Column, int]]
) -> DataFrame:
    """``outputs``: name -> (value, rows). Averages the last ``rows`` rows including this one."""
    w = ordered(keys, order)
    return df.withColumns(
        {
            name: F.avg(value).over(w.rowsBetween(-(rows - 1), Window.currentRow))
            for name, (value, rows) in outputs.items()
        }
    )


def prior_avg(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: Mapping[str, str | Column],
    rows: int = 3,
) -> DataFrame:
    """Average over the ``rows`` rows before this one; NULL on the first row."""
    w = ordered(keys, order).rowsBetween(-rows, -1)
    return df.withColumns({name: F.avg(value).over(w) for name, value in outputs.items()})


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, outputs: Mapping[str, str | Column]
) -> DataFrame:
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({name: F.sum(value).over(w) for name, value in outputs.items()})


def forward_values(
    df: DataFrame, keys: Sequence[str], order: str, value: str, steps: Mapping[str, int]
) -> DataFrame:
    """``steps``: name -> n. The value ``n`` rows ahead, all from one window pass."""
    w = ordered(keys, order)
    return df.withColumns({name: F.lead(value, n).over(w) for name, n in steps.items()})


def latest_value(df: DataFrame, keys: Sequence[str], order: str, outputs: Mapping[str, str]) -> DataFrame:
    """Put each key's value at its newest row (NULL included) on every row.

    A whole-partition frame in ascending order, so it shares the sort of the
    other windows over the same key.
    """
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({name: F.last(value).over(w) for name, value in outputs.items()})


def trailing_median_column(account: str, day: str, value: str | Column, days: int = 60) -> Column:
    """Median over the calendar days [d - days, d], as a window column.

    For inputs with one row per account and day.
    """
    w = ordered([account], "_day_no").rangeBetween(-days, Window.currentRow)
    return F.percentile(value, F.lit(0.5)).over(w)


def trailing_median(
    df: DataFrame, account: str, day: str, value: str, days: int = 60, out: str = "trailing_median"
) -> DataFrame:
    """Distinct (account, day, value) rows with the median of the trailing days.

    Days that repeat with different values stay separate rows and all count.
    Time is cut into blocks of ``days`` days and each row is also copied into
    the next block as look-back, so one account's history is spread over many
    tasks and no task holds more than two blocks of it.
    """
    block = F.floor(F.col("_day_no") / days).cast("int")
    rows = (
        df.select(account, day, value)
        .dropDuplicates()
        .withColumn("_day_no", F.unix_date(day))
        .withColumn("_home", block)
        .withColumn("_block", F.explode(F.array("_home", F.col("_home") + 1)))
    )
    w = (
        Window.partitionBy(account, "_block")
        .orderBy("_day_no")
        .rangeBetween(-days, Window.currentRow)
    )
    return (
        rows.withColumn(out, F.percentile(value, F.lit(0.5)).over(w))
        .filter(F.col("_block") == F.col("_home"))
        # a row without an account matches no other row, so it has no median
        .withColumn(out, F.when(F.col(account).isNotNull(), F.col(out)))
        .select(account, day, value, out)
    )
