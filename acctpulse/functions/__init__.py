"""Column helpers whose null, rounding and calendar rules matter to the results."""

from acctpulse.functions.calendar import (
    days_between,
    minute_diff,
    month_diff,
    month_start,
    previous_month_end,
    week_close_after,
    week_close_before,
    year_diff,
)
from acctpulse.functions.numeric import (
    dec0,
    dec2,
    div0,
    flag01,
    greatest_strict,
    least_strict,
    mean_non_null,
    or_na,
    percentile_score,
    safe_div,
    zero_if_null,
)

__all__ = [
    "days_between",
    "dec0",
    "dec2",
    "div0",
    "flag01",
    "greatest_strict",
    "least_strict",
    "mean_non_null",
    "minute_diff",
    "month_diff",
    "month_start",
    "or_na",
    "percentile_score",
    "previous_month_end",
    "safe_div",
    "week_close_after",
    "week_close_before",
    "year_diff",
    "zero_if_null",
]
