"""Per-segment regression, correlation, variance inflation and feature importance.

Spark reduces each segment to its moments; only those small matrices are
solved with numpy, inside a task, one row per segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.functions import safe_div
from acctpulse.operators.forest import importances
from acctpulse.operators.moments import group_moments, pair_moments
from acctpulse.plans.segments import SEGMENTS, complete_cases
from acctpulse.session import materialize

OLS_SCHEMA = "segment_name string, term string, coefficient double, p_value double, r_squared double, n long"
#: Memory of a task for the statistics of the nodes that one pass over the rows splits.
NODE_MB = 512
VIF_SCHEMA = "segment_name string, feature string, vif double"


def segment_ols(
    df: DataFrame, columns: Sequence[str], target: str, segment: str = "segment_name"
) -> DataFrame:
    """Least squares with intercept per segment, on complete rows.

    A segment without a complete row has no result. Collinear columns share
    the minimum-norm solution. P-values are two-sided t tests.
    """
    names = list(columns)
    rows = complete_cases(df, names, target)
    moments = group_moments(rows, segment, [*names, target]).withColumnRenamed(segment, "segment_name")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for record in batch.to_dict("records"):
                yield _ols_rows(record, names)

    return moments.mapInPandas(solve, OLS_SCHEMA)


def _unpack(record: dict, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    mean, cov = np.empty(k), np.empty((k, k))
    for pair in record["pairs"]:
        i, j = pair["i"], pair["j"]
        mean[i], mean[j] = pair["mean_i"], pair["mean_j"]
        cov[i, j] = cov[j, i] = pair["cov"]
    return int(record["n"]), mean, cov


def _ols_rows(record: dict, names: list[str]) -> pd.DataFrame:
    k = len(names)
    n, mean, cov = _unpack(record, k + 1)
    sxx, sxy, syy = cov[:k, :k] * n, cov[:k, k] * n, cov[k, k] * n
    # unit diagonal before the inverse: the metrics differ by orders of magnitude
    scale = np.sqrt(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0))
    unit = sxx / np.outer(scale, scale)
    inverse = np.linalg.pinv(unit, rcond=1e-12, hermitian=True) / np.outer(scale, scale)
    beta = inverse @ sxy
    intercept = mean[k] - beta @ mean[:k]
    residual = max(syy - beta @ sxy, 0.0)
    freedom = n - 1 - int(np.linalg.matrix_rank(unit, tol=1e-12, hermitian=True))
    r_squared = 1.0 - residual / syy if syy > 0 else float("nan")
    if freedom > 0:
        sigma2 = residual / freedom
        variances = np.r_[1.0 / n + mean[:k] @ inverse @ mean[:k], np.diag(inverse)] * sigma2
    else:
        variances = np.full(k + 1, np.nan)
    coefficients = np.r_[intercept, beta]
    return pd.DataFrame(
        {
            "segment_name": record["segment_name"],
            "term": ["const", *names],
            "coefficient": coefficients,
            "p_value": [_t_test(c, v, freedom) for c, v in zip(coefficients, variances)],
            "r_squared": r_squared,
            "n": n,
        }
    )


def _t_test(coefficient: float, variance: float, freedom: int) -> float:
    """Two-sided p-value of coefficient / standard error."""
    if not variance > 0 or freedom <= 0:
        return float("nan")
    t2 = coefficient * coefficient / variance
    return _beta_tail(freedom / 2.0, 0.5, freedom / (freedom + t2))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    # convergents p/q of 1 + d1/(1 + d2/(1 + ...))
    p0, q0, p1, q1 = 1.0, 0.0, 1.0, 1.0
    value = 1.0
    for i in range(1, 2000):
        m = i // 2
        if i % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        p0, p1 = p1, p1 + d * p0
        q0, q1 = q1, q1 + d * q0
        p0, q0, p1, q1 = p0 / q1, q0 / q1, p1 / q1, 1.0
        if abs(p1 - value) < 1e-15 * abs(p1):
            break
        value = p1
    return front / (a * p1)


def segment_correlation(
    df: DataFrame, columns: Sequence[str], segment: str = "segment_name"
) -> DataFrame:
    """Pearson correlation matrix per segment in long form, over rows where both are present.

    NULL where a column is constant or fewer than two rows are present.
    """
    names = F.array(*[F.lit(c) for c in columns])
    a, b = names[F.col("i")], names[F.col("j")]
    spread = F.sqrt("var_i") * F.sqrt("var_j")
    cells = pair_moments(df, segment, columns).select(
        segment, a.alias("a"), b.alias("b"), (F.col("i") != F.col("j")).alias("off_diagonal"),
        safe_div("cov", spread).alias("corr"),
    )
    # the lower triangle mirrors the upper one
    both = F.filter(
        F.array(
            F.struct(F.col("a").alias("metric_a"), F.col("b").alias("metric_b"), F.lit(True).alias("keep")),
            F.struct(F.col("b").alias("metric_a"), F.col("a").alias("metric_b"), F.col("off_diagonal").alias("keep")),
        ),
        lambda cell: cell["keep"],
    )
    return cells.select(segment, F.inline(both), "corr").drop("keep")


def segment_vif(df: DataFrame, columns: Sequence[str], segment: str = "segment_name") -> DataFrame:
    """Variance inflation of each metric per segment, highest first within a segment.

    The regressions have no intercept, so each metric's residual on the others
    follows from the uncentred Gram matrix. A metric that the others explain has
    an infinite factor, one that is zero throughout has none (NaN); neither
    touches the factors of the rest.
    """
    names = list(columns)
    rows = df.dropna(subset=names)
    moments = group_moments(rows, segment, names).withColumnRenamed(segment, "segment_name")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for record in batch.to_dict("records"):
                yield _vif_rows(record, names)

    return moments.mapInPandas(solve, VIF_SCHEMA).orderBy("segment_name", F.col("vif").desc_nulls_last())


def _vif_rows(record: dict, names: list[str]) -> pd.DataFrame:
    _, mean, cov = _unpack(record, len(names))
    gram = cov + np.outer(mean, mean)
    size = np.diag(gram)
    scale = np.sqrt(np.where(size > 0, size, 1.0))
    unit = gram / np.outer(scale, scale)
    vif = np.full(len(names), np.nan)
    for i in np.flatnonzero(size > 0):
        rest = np.delete(np.arange(len(names)), i)
        shared = unit[rest, i]
        left = 1.0 - shared @ np.linalg.pinv(unit[np.ix_(rest, rest)], rcond=1e-12, hermitian=True) @ shared
        vif[i] = 1.0 / left if left > 1e-10 else np.inf
    return pd.DataFrame({"segment_name": record["segment_name"], "feature": names, "vif": vif})


def rf_importance(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    segment: str = "segment_name",
    segments: Sequence[str] = SEGMENTS,
    trees: int = 100,
    seed: int = 42,
    max_depth: int = 30,
) -> DataFrame:
    """Random-forest importance of each metric per segment, highest first.

    One distributed fit per named segment, over rows that are written once;
    the lower nodes are grown inside tasks. A segment without a complete row is
    skipped.
    """
    names = list(columns)
    complete = complete_cases(df, names, target).filter(F.col(segment).isin(*segments))
    rows = materialize(
        complete.select(segment, *[F.col(c).cast("double").alias(c) for c in [*names, target]]),
        "forest_rows",
    )
    assembler = VectorAssembler(inputCols=names, outputCol="features")

    def fit(part: DataFrame, depth: int):
        forest = RandomForestRegressor(
            featuresCol="features",
            labelCol=target,
            numTrees=trees,
            featureSubsetStrategy="all",
            maxDepth=depth,
            seed=seed,
            cacheNodeIds=True,
            maxMemoryInMB=NODE_MB,
        )
        return forest, forest.fit(assembler.transform(part))

    # at most one row per named segment
    present = {r[0]: r[1] for r in rows.groupBy(segment).count().collect()}
    wanted = [s for s in segments if s in present]
    parts = [rows.filter(F.col(segment) == name) for name in wanted]
    found = importances(parts, [present[s] for s in wanted], names, target, fit, max_depth) if wanted else []
    found = [(s, c, float(v)) for s, values in zip(wanted, found) for c, v in zip(names, values)]
    spark = df.sparkSession
    return spark.createDataFrame(found, "segment_name string, feature string, importance double").orderBy(
        "segment_name", F.col("importance").desc()
    )
