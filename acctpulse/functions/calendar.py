"""Calendar arithmetic.

Month, year and minute differences count the boundaries crossed, so
31 January to 1 February is one month. Spark's own ``months_between`` and
``timestampdiff`` count completed units and would give 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(d: Column | str) -> Column:
    """First day of the month, as DATE (``date_trunc`` would give TIMESTAMP)."""
    return F.trunc(_col(d), "MM")


def previous_month_end(d: Column | str) -> Column:
    """Last day of the month before ``d``."""
    return F.last_day(F.add_months(_col(d), -1))


def month_diff(start: Column | str, end: Column | str) -> Column:
    s, e = _col(start), _col(end)
    return (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)


def year_diff(start: Column | str, end: Column | str) -> Column:
    return F.year(_col(end)) - F.year(_col(start))


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(_col(end), _col(start))


def minute_diff(start: Column | str, end: Column | str) -> Column:
    """Minute boundaries between two timestamps."""
    s = F.date_trunc("minute", _col(start))
    e = F.date_trunc("minute", _col(end))
    return F.timestamp_diff("MINUTE", s, e)


def week_close_before(d: Column | str) -> Column:
    """The Sunday on or before ``d``."""
    return F.date_sub(F.next_day(_col(d), "SUN"), 7)


def week_close_after(d: Column | str) -> Column:
    """The Sunday on or after ``d``: last day of the Monday-to-Sunday week."""
    return F.date_add(F.trunc(_col(d), "week").cast("date"), 6)
