"""Wide to long and long to indicator columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_keep_nulls(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def unpivot_drop_nulls(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value).filter(F.col(value).isNotNull())


def presence_flags(
    df: DataFrame, keys: Sequence[str], label: str | Column, flags: Mapping[str, str]
) -> DataFrame:
    """``flags``: output -> label. 1 where the group has the label, else 0."""
    c = F.col(label) if isinstance(label, str) else label
    return df.groupBy(*keys).agg(
        *[F.max(F.when(c == v, 1).otherwise(0)).alias(out) for out, v in flags.items()]
    )


def distinct_list(df: DataFrame, keys: Sequence[str], value: str, out: str, sep: str = ", ") -> DataFrame:
    """Ordered, de-duplicated, joined labels per group."""
    return (
        df.select(*keys, value)
        .dropDuplicates()
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(out))
    )
