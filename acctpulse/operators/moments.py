"""Per-group means, variances and covariances of column pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_moments(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per group and column pair i <= j, over rows where both are present.

    Columns: key, i, j, n, mean_i, mean_j, var_i, var_j, cov (population).
    For a few groups of any size: every task reduces its rows to one small
    matrix per group, so rows are never shuffled by group and an uneven group
    costs nothing. Partial results are centred, and merged as centred moments.
    """
    names = list(columns)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(F.col(key).alias("_group"), *[F.col(c).cast("double").alias(c) for c in names])
    schema = (
        f"_group {fields[key]}, i int, j int, n double, mean_i double, mean_j double,"
        " ss_i double, ss_j double, sp double"
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for group, part in batch.groupby("_group", dropna=False):
                group = None if pd.isna(group) else group
                sums[group] = _add(sums.get(group), part[names].to_numpy(dtype=float))
        for group, state in sums.items():
            yield _pairs(group, *state)

    same_pair = Window.partitionBy("_group", "i", "j")
    n = F.col("n")

    def overall(mean: str):
        return F.sum(n * F.col(mean)).over(same_pair) / F.nullif(F.sum("n").over(same_pair), F.lit(0.0))

    parts = rows.mapInPandas(partial, schema).withColumns(
        {"off_i": F.col("mean_i") - overall("mean_i"), "off_j": F.col("mean_j") - overall("mean_j")}
    )

    def merged(own: str, a: str, b: str):
        return F.sum(F.col(own) + n * F.col(a) * F.col(b)) / F.nullif(F.sum("n"), F.lit(0.0))

    def mean(of: str):
        return F.sum(n * F.col(of)) / F.nullif(F.sum("n"), F.lit(0.0))

    merged_pairs = parts.groupBy(F.col("_group").alias(key), "i", "j").agg(
        F.sum("n").cast("long").alias("n"),
        mean("mean_i").alias("mean_i"),
        mean("mean_j").alias("mean_j"),
        merged("ss_i", "off_i", "off_i").alias("var_i"),
        merged("ss_j", "off_j", "off_j").alias("var_j"),
        merged("sp", "off_i", "off_j").alias("cov"),
    )

    def spread(var: str, centre: str):
        # below the square of the mean's own rounding error there is no variance
        return F.when(F.col(var) > F.col(centre) * F.col(centre) * 1e-29, F.col(var)).when(
            F.col(var).isNotNull(), 0.0
        )

    return merged_pairs.withColumns(
        {"var_i": spread("var_i", "mean_i"), "var_j": spread("var_j", "mean_j")}
    )


def _add(state, x: np.ndarray):
    """Sums over pairs of present values, around the first value seen of each column."""
    k = x.shape[1]
    present = ~np.isnan(x)
    if state is None:
        state = tuple(np.zeros(k) if d == 1 else np.zeros((k, k)) for d in (1, 2, 2, 2, 2))
    shift, n, s, ss, sp = state
    new = (np.diag(n) == 0) & present.any(axis=0)
    first = x[present.argmax(axis=0), np.arange(k)]
    shift = np.where(new, first, shift)
    m = present.astype(float)
    c = np.where(present, x - shift, 0.0)
    return shift, n + m.T @ m, s + c.T @ m, ss + (c * c).T @ m, sp + c.T @ c


def _pairs(group, shift, n, s, ss, sp) -> pd.DataFrame:
    """Row a, column b of ``s`` and ``ss`` sum column a over rows where b is present."""
    i, j = np.triu_indices(len(shift))
    count = n[i, j]
    safe = np.maximum(count, 1.0)

    def centred(raw, total):
        rest = raw - total**2 / safe
        return np.where(rest > 1e-14 * raw, rest, 0.0)  # a constant column has none

    return pd.DataFrame(
        {
            "_group": [group] * len(i),
            "i": i.astype(np.int32),
            "j": j.astype(np.int32),
            "n": count,
            "mean_i": shift[i] + s[i, j] / safe,
            "mean_j": shift[j] + s[j, i] / safe,
            "ss_i": centred(ss[i, j], s[i, j]),
            "ss_j": centred(ss[j, i], s[j, i]),
            "sp": sp[i, j] - s[i, j] * s[j, i] / safe,
        }
    )


def group_moments(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per group: n and its pairs (i, j, mean_i, mean_j, cov) as an array.

    Rows must be complete, so that n is the same for every pair. The array has
    k * (k + 1) / 2 entries for k columns, whatever the size of the group.
    """
    entry = F.struct("i", "j", "mean_i", "mean_j", "cov")
    return (
        pair_moments(df, key, columns)
        .groupBy(key)
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("pairs"))
    )
