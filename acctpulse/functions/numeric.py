"""Numeric and null-handling helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def zero_if_null(c) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def safe_div(a, b) -> Column:
    """``a / b``, NULL where ``b`` is 0 (a bare ``/`` raises in ANSI mode)."""
    return _col(a) / F.nullif(_col(b), F.lit(0))


def div0(a, b) -> Column:
    """``a / b``, but 0 where ``b`` is 0 and NULL where either side is NULL."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(0.0))).otherwise(a / F.nullif(b, F.lit(0.0)))


def _strict(fn, cols) -> Column:
    cols = [_col(c) for c in cols]
    any_null = reduce(lambda x, y: x | y, [c.isNull() for c in cols])
    return F.when(~any_null, fn(*cols))


def greatest_strict(*cols) -> Column:
    """Largest argument, NULL if any argument is NULL (``F.greatest`` skips NULLs)."""
    return _strict(F.greatest, cols)


def least_strict(*cols) -> Column:
    """Smallest argument, NULL if any argument is NULL."""
    return _strict(F.least, cols)


def dec0(c) -> Column:
    """Whole-number decimal, halves rounded away from zero."""
    return _col(c).cast("decimal(38,0)")


def dec2(c) -> Column:
    """The common type of all panel metrics, so that they unpivot together."""
    return _col(c).cast("decimal(18,2)")


def flag01(c) -> Column:
    """Boolean to 1/0, NULL to 0."""
    return F.coalesce(_col(c).cast("int"), F.lit(0))


def or_na(c, *placeholders: str) -> Column:
    """NULL and placeholder labels become 'NA'."""
    c = _col(c)
    missing = c.isNull()
    if placeholders:
        missing = missing | c.isin(*placeholders)
    return F.when(missing, F.lit("NA")).otherwise(c)


def mean_non_null(cols) -> Column:
    """Rounded mean of the non-NULL columns; 0 when all are NULL."""
    cols = [_col(c) for c in cols]
    n = reduce(lambda x, y: x + y, [c.isNotNull().cast("int") for c in cols])
    total = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0).cast("decimal(38,0)")) for c in cols])
    # Scores are whole numbers, so the double quotient has the exact half cases.
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.round(total.cast("double") / F.nullif(n, F.lit(0)), 0)
    )


def percentile_score(value, low, high, *, if_null, if_no_range=50, inverse=False) -> Column:
    """Scale ``value`` between two percentiles to 0-100.

    ``if_null`` (may be None) scores a missing value and ``if_no_range`` a
    missing percentile. ``inverse`` gives high scores to low values.
    """
    v, lo, hi = (_col(x).cast("double") for x in (value, low, high))
    worst, best = (100.0, 0.0) if inverse else (0.0, 100.0)
    null_score = F.lit(None if if_null is None else float(if_null)).cast("double")
    scaled = (v - lo) * 100.0 / F.nullif(hi - lo, F.lit(0.0))
    if inverse:
        scaled = 100.0 - scaled
    return (
        F.when(v.isNull(), null_score)
        .when(lo.isNull() | hi.isNull(), F.lit(float(if_no_range)))
        .when(v <= lo, F.lit(worst))
        .when(v >= hi, F.lit(best))
        .when(hi == lo, F.lit(50.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), scaled)))
    )
