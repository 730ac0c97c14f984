import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from acctpulse.operators import quantiles
from acctpulse.operators.quantiles import exact_quantiles
from acctpulse.plans import models, segments
from acctpulse.registry import AS_OF
from acctpulse.sources.inputs import Inputs

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_small_groups_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.p: r.q for r in exact_quantiles(df, [], ["v"], PROBS).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(np.percentile(values, p * 100), abs=1e-9)


def test_hot_group_with_a_dominant_value(spark):
    rng = np.random.default_rng(1)
    big = np.where(rng.random(60000) < 0.35, 7.0, np.round(rng.lognormal(3, 2, 60000), 2))
    pdf = pd.DataFrame({"k": ["hot"] * 60000 + ["cold"] * 5, "v": np.r_[big, [1, 2, 3, 4, 10.0]]})
    pdf.loc[3, "k"] = None
    got = {(r.k, r.p): r.q for r in exact_quantiles(frame(spark, pdf), ["k"], ["v"], PROBS).collect()}
    for k in ("hot", "cold"):
        want = np.percentile(pdf[pdf.k == k].v, [p * 100 for p in PROBS])
        assert [got[k, p] for p in PROBS] == pytest.approx(list(want), rel=1e-12)
    assert got[None, 0.5] == pdf.loc[3, "v"]


def test_sketch_much_coarser_than_the_data_stays_exact(spark):
    values = np.random.default_rng(2).permutation(30000).astype(float)
    df = frame(spark, pd.DataFrame({"v": values}))
    got = {r.p: r.q for r in exact_quantiles(df, [], ["v"], PROBS, accuracy=50).collect()}
    assert [got[p] for p in PROBS] == pytest.approx(list(np.percentile(values, [p * 100 for p in PROBS])))


@pytest.mark.parametrize("ties", ["none", "edges", "one"])
def test_many_passes_stay_exact(spark, ties):
    """Sketches and brackets so small that every rank is narrowed again and again, also between heavy ties."""
    rng = np.random.default_rng(4)
    n = 20000
    values = rng.normal(0, 1, n)
    if ties == "edges":
        values = np.where(rng.random(n) < 0.495, -9.0, np.where(rng.random(n) < 0.98, 9.0, values))
    elif ties == "one":
        values = np.full(n, 3.5)
    groups = np.where(np.arange(n) % 10 == 0, "small", "large")
    df = frame(spark, pd.DataFrame({"k": groups, "v": values})).repartition(7)
    some = [0.0, 0.5, 0.99]
    got = {(r.k, r.p): r.q for r in exact_quantiles(df, ["k"], ["v"], some, accuracy=128, most=100).collect()}
    for k in ("small", "large"):
        want = np.percentile(values[groups == k], [p * 100 for p in some])
        assert [got[k, p] for p in some] == pytest.approx(list(want), rel=1e-12)


@pytest.mark.parametrize("n", [1_000_000, 16_000_000])
def test_rows_that_reach_the_window_do_not_grow(spark, n, monkeypatch):
    """Half of all rows have one value; the rest differ. What the last step groups and sorts has the same bound at any size."""
    met = []
    inside = quantiles._inside
    monkeypatch.setattr(quantiles, "_inside", lambda *a: met.append(inside(*a)) or met[0])
    v = "CASE WHEN id % 2 = 0 THEN 0.25D ELSE pmod(xxhash64(id), 1000000007) / 1000000007D END AS v"
    got = {r.p: r.q for r in exact_quantiles(spark.range(n).selectExpr(v), [], ["v"], [0.01, 0.5, 0.9]).collect()}
    assert met[0].count() <= 3 * (quantiles.MOST + 2)
    assert [got[p] for p in (0.01, 0.5, 0.9)] == pytest.approx([0.02, 0.25, 0.8], abs=0.002)


def test_null_only_column_has_no_quantile(rows):
    df = rows("k string, v double, w double", ("a", None, 1.0))
    assert [r.metric for r in exact_quantiles(df, ["k"], ["v", "w"], [0.5]).collect()] == ["w"]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 500
    a = rng.normal(100, 5, n)
    b = rng.normal(0, 1, n) + a / 50
    pdf = pd.DataFrame({"segment_name": np.where(np.arange(n) % 3 == 0, "x", "y"), "a": a, "b": b, "c": 4.0})
    pdf["y"] = 2 + 3 * a - b + rng.normal(0, 1, n)
    pdf.loc[::7, "a"] = np.nan
    return pdf


def test_ols_against_lstsq(spark, sample):
    got = models.segment_ols(frame(spark, sample), ["a", "b"], "y").toPandas().set_index(["segment_name", "term"])
    for seg, part in sample.dropna().groupby("segment_name"):
        x = np.c_[np.ones(len(part)), part.a, part.b]
        beta, *_ = np.linalg.lstsq(x, part.y, rcond=None)
        rest = part.y - x @ beta
        assert list(got.loc[seg].loc[["const", "a", "b"], "coefficient"]) == pytest.approx(list(beta), rel=1e-6)
        r2 = 1 - (rest**2).sum() / ((part.y - part.y.mean()) ** 2).sum()
        assert got.loc[seg].r_squared.iloc[0] == pytest.approx(r2)
        assert got.loc[seg].n.iloc[0] == len(part)


@pytest.mark.parametrize("t, df, p", [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (12.706, 1, 0.05), (0.0, 5, 1.0)])
def test_t_test(t, df, p):
    assert models._t_test(t, 1.0, df) == pytest.approx(p, abs=2e-4)


def test_p_values_agree_with_the_ml_library(spark, sample):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    part = frame(spark, sample[sample.segment_name == "y"].dropna())
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(part)
    summary = LinearRegression(labelCol="y", solver="normal").fit(vec).summary
    got = models.segment_ols(part, ["a", "b"], "y").toPandas().set_index("term")
    assert list(got.loc[["a", "b", "const"], "p_value"]) == pytest.approx(list(summary.pValues), abs=1e-7)


def test_vif_against_regressions_without_intercept(spark, sample):
    got = models.segment_vif(frame(spark, sample.drop(columns="y")), ["a", "b", "c"]).toPandas()
    for seg, part in sample.dropna().groupby("segment_name"):
        x = part[["a", "b", "c"]].to_numpy()
        for i, name in enumerate("abc"):
            rest = np.delete(x, i, axis=1)
            beta, *_ = np.linalg.lstsq(rest, x[:, i], rcond=None)
            want = (x[:, i] ** 2).sum() / ((x[:, i] - rest @ beta) ** 2).sum()
            row = got[(got.segment_name == seg) & (got.feature == name)]
            assert row.vif.iloc[0] == pytest.approx(want, rel=1e-5)
    assert all(g.vif.is_monotonic_decreasing for _, g in got.groupby("segment_name"))


def test_correlation_against_pandas(spark, sample):
    cols = ["a", "b", "c", "y"]
    got = models.segment_correlation(frame(spark, sample), cols).toPandas()
    for seg, part in sample.groupby("segment_name"):
        want = part[cols].corr()
        for r in got[got.segment_name == seg].itertuples():
            w = want.loc[r.metric_a, r.metric_b]
            assert (math.isnan(w) and (r.corr is None or math.isnan(r.corr))) or r.corr == pytest.approx(w)
    assert len(got) == 2 * 16


def test_segment_without_complete_rows_is_skipped(rows):
    df = rows("segment_name string, a double, y double", ("x", None, 1.0), ("y", 1.0, 1.0), ("y", 2.0, 3.0))
    assert {r.segment_name for r in models.segment_ols(df, ["a"], "y").collect()} == {"y"}
    found = models.rf_importance(df, ["a"], "y", segments=["x", "y"], trees=2, max_depth=2)
    assert {r.segment_name for r in found.collect()} == {"y"}


def test_forest_ranks_the_driver_first(spark, sample):
    pdf = sample.dropna().assign(noise=lambda d: np.arange(len(d)) % 13)
    df = frame(spark, pdf)
    out = models.rf_importance(df, ["a", "noise"], "y", segments=["x"], trees=10, max_depth=4).collect()
    assert [r.feature for r in out if r.segment_name == "x"] == ["a", "noise"]


def test_segments_by_age_and_program(rows):
    df = rows(
        "account_id long, account_name string, term_start date, latest_program string",
        (1, "a", date(2001, 2, 1), "Volume Plan"),
        (1, "a", date(2001, 7, 1), "Volume Plan"),
        (2, "b", date(2001, 1, 31), "Volume Plan"),
        (3, "c", date(2001, 7, 1), "Savings Plan"),
        (4, "d", date(1999, 7, 1), "PAYG"),
        (5, "e", date(1999, 7, 1), "Enterprise"),
    )
    got = sorted((r.account_id, r.segment_name) for r in segments.account_segments(df, AS_OF).collect())
    early, late = "Early Volume Plan", "Late Volume Plan"
    assert got == [(1, early), (1, early), (2, late), (3, "Early Savings Plan"), (4, "PAYG")]


def test_all_missing_metric_stays_missing(rows):
    df = rows(
        "segment_name string, m double, k double", ("x", None, 1.0), ("x", None, None), ("y", 4.0, None), ("y", None, 3.0)
    )
    out = segments.impute_segment_median(df, ["m", "k"])
    got = sorted(((r.segment_name, r.m, r.k) for r in out.collect()), key=str)
    assert got == [("x", None, 1.0), ("x", None, 1.0), ("y", 4.0, 3.0), ("y", 4.0, 3.0)]


def test_null_profile_invariants(spark, data):
    seg = segments.account_segments(Inputs(spark, data).metric_panel(), AS_OF)
    profile = segments.null_profile(seg, [*segments.MODEL_METRICS, segments.TARGET]).collect()
    assert {r.segment_name for r in profile} <= set(segments.SEGMENTS)
    for r in profile:
        assert r.resolution_rate == r.open_tickets
        assert r.pct_p1_cases == r.pct_p1p2_cases
        assert r.engagement_score == r.sentiment_score
        assert r.pct_m_plus_6_bcm == 0.0


def test_names_and_coercion(rows):
    assert segments.metric_names(["A_HSCORE", "B", "C_HSCORE"]) == ["A", "C"]
    got = segments.coerce_numeric(rows("x string", ("1.5",), ("n/a",), (None,)), ["x"]).collect()
    assert [r.x for r in got] == [1.5, None, None]


def test_deep_forests_do_not_travel_with_every_pass(rows, monkeypatch):
    made, plain = [], models.RandomForestRegressor
    monkeypatch.setattr(models, "RandomForestRegressor", lambda **given: made.append(plain(**given)) or made[-1])
    df = rows("segment_name string, a double, y double", ("x", 1.0, 1.0), ("x", 2.0, 3.0))
    assert models.rf_importance(df, ["a"], "y", segments=["x"], trees=2, max_depth=2).count() == 1
    assert [f.getCacheNodeIds() for f in made] == [True]
