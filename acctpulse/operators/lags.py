"""Values of earlier weeks placed next to the current week."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctpulse.session import spread

ACCOUNT, WEEK = "account_id", "close_week"


def lag_name(value: str, lag: int) -> str:
    return value if lag == 0 else f"{value}_{lag}"


def lag_features(
    spine: DataFrame, *sources: tuple[DataFrame, Mapping[str, Sequence[int]]]
) -> DataFrame:
    """Spine rows plus each value as it was some weeks before.

    A source is (weekly rows, {value: lags}) with one row per account and week.
    Instead of one join per value and lag, spine and source rows are stacked
    and RANGE frames that span exactly one date pick the lags: one shuffle by
    account for any number of sources, over partitions that grow in number with
    the input. A window partition holds one row per
    week of the account from the spine and from each source. Spine rows without
    an account meet no source row; they are spread by their content.
    """
    loose = F.when(F.col(ACCOUNT).isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in spine.columns]))
    stacked = spine.withColumns({"_is_spine": F.lit(True), "_loose": loose, "_day_no": F.unix_date(WEEK)})
    wanted: list[tuple[str, int]] = []
    for weekly, values in sources:
        clash = (set(spine.columns) | {v for v, _ in wanted}) & set(values)
        if clash:
            raise ValueError(f"column names used twice: {sorted(clash)}")
        wanted += [(v, k) for v, lags in values.items() for k in lags]
        # rows without an account or week could match no spine row; without the week itself, they are not
        # known to be grouped as others are, so that a task of the union holds one source only
        rows = weekly.dropna(subset=[ACCOUNT, WEEK]).select(ACCOUNT, F.unix_date(WEEK).alias("_day_no"), *values)
        stacked = stacked.unionByName(rows.withColumn("_is_spine", F.lit(False)), allowMissingColumns=True)
    marked = spread(stacked, ACCOUNT, "_loose").select(
        "*", *[F.max(v).over(_weeks_back(k)).alias(f"_at_{lag_name(v, k)}") for v, k in wanted]
    )
    return marked.filter("_is_spine").select(
        *spine.columns,
        *[F.col(f"_at_{lag_name(v, k)}").alias(lag_name(v, k)) for v, k in wanted],
    )


def _weeks_back(lag: int):
    return Window.partitionBy(ACCOUNT, "_loose").orderBy("_day_no").rangeBetween(-7 * lag, -7 * lag)


def lag_join(spine: DataFrame, weekly: DataFrame, value: str, lags: Sequence[int]) -> DataFrame:
    """The same by one left join per lag, for a right side that may repeat a week.

    Every repeated row fans out, as a join does.
    """

    def one(left: DataFrame, k: int) -> DataFrame:
        right = weekly.select(
            ACCOUNT, F.date_add(WEEK, 7 * k).alias(WEEK), F.col(value).alias(lag_name(value, k))
        )
        return left.join(right, [ACCOUNT, WEEK], "left")

    return reduce(one, lags, spine)


def with_ratios(
    df: DataFrame, pairs: Mapping[str, tuple[str, str]], div: Callable[[str, str], Column]
) -> DataFrame:
    """``pairs``: output -> (numerator, denominator)."""
    return df.withColumns({name: div(a, b) for name, (a, b) in pairs.items()})
