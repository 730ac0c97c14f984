import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor

from acctpulse.operators import forest
from acctpulse.plans import models


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    """Rows read from files at the places they have for both forests: bags depend on places."""

    def build(n, y, parts=3):
        a, b, c = np.arange(n) * 7919 % n / 8, np.arange(n) % 11 - 5.0, np.arange(n) % 3
        rows = [("x", float(p), float(q), float(r), 1.0, float(v)) for p, q, r, v in zip(a, b, c, y(a, b, c))]
        frame = spark.createDataFrame(rows, "segment_name string, a double, b double, c double, one double, y double")
        frame.repartition(parts).write.parquet(f"{tmp_path}/rows")
        read = spark.read.parquet(f"{tmp_path}/rows")
        monkeypatch.setattr(models, "materialize", lambda df, name: read)
        return read

    return build


def noise(n):
    return np.arange(n) * 104729 % 1009 / 16


def of_spark_ml(rows, trees, depth):
    vectors = VectorAssembler(inputCols=["a", "b", "c", "one"], outputCol="features").transform(rows)
    given = RandomForestRegressor(labelCol="y", numTrees=trees, featureSubsetStrategy="all", maxDepth=depth, seed=42)
    return dict(zip(["a", "b", "c", "one"], given.fit(vectors).featureImportances.toArray()))


@pytest.mark.parametrize("task_rows, trees", [(1 << 20, 12), (1500, 3)])
def test_importances_are_those_of_the_full_fit(written, monkeypatch, task_rows, trees):
    # more rows than Spark ML chooses bins from
    rows = written(12_000, lambda a, b, c: np.floor(a / 50) * c + b + noise(len(a)))
    monkeypatch.setattr(forest, "TASK_ROWS", task_rows)
    want = of_spark_ml(rows, trees, 6)
    out = models.rf_importance(rows, list(want), "y", segments=["x"], trees=trees, max_depth=6).collect()
    assert {r.feature: r.importance for r in out} == pytest.approx(want, abs=1e-12)
    assert sum(r.importance for r in out) == pytest.approx(1.0)


@pytest.mark.parametrize("n, trees", [(300, 1), (40, 5), (2, 4), (1, 3)])
def test_full_depth_of_few_rows(written, n, trees):
    rows = written(n, lambda a, b, c: a * a + b + noise(len(a)) / 4)
    want = of_spark_ml(rows, trees, 30)
    out = models.rf_importance(rows, list(want), "y", segments=["x"], trees=trees).collect()
    assert {r.feature: r.importance for r in out} == pytest.approx(want, abs=1e-12)


def test_sums_that_are_not_exact_decide_ties_only(written):
    rows = written(300, lambda a, b, c: a * a / 7 + b + noise(len(a)) / 3)
    want = of_spark_ml(rows, 20, 30)
    out = models.rf_importance(rows, list(want), "y", segments=["x"], trees=20).collect()
    assert {r.feature: r.importance for r in out} == pytest.approx(want, abs=1e-3)


def test_the_driver_gets_no_deep_tree(written, monkeypatch):
    made, plain = [], models.RandomForestRegressor
    monkeypatch.setattr(models, "RandomForestRegressor", lambda **given: made.append(plain(**given)) or made[-1])
    rows = written(400, lambda a, b, c: a + noise(len(a)))
    out = models.rf_importance(rows, ["a", "b"], "y", segments=["x"], trees=5).collect()
    assert len(out) == 2
    assert [f.getMaxDepth() for f in made] == [0]


def test_hot_node_is_split_further(written, monkeypatch):
    # each split takes a few rows with high values off
    rows = written(3000, lambda a, b, c: 2.0 ** np.floor(a / 24) + noise(len(a)) / 64)
    monkeypatch.setattr(forest, "TASK_ROWS", 700)
    fitted, plain = [], models.RandomForestRegressor
    monkeypatch.setattr(models, "RandomForestRegressor", lambda **given: fitted.append(given["maxDepth"]) or plain(**given))
    want = of_spark_ml(rows, 3, 9)
    out = models.rf_importance(rows, list(want), "y", segments=["x"], trees=3, max_depth=9).collect()
    assert {r.feature: r.importance for r in out} == pytest.approx(want, abs=1e-12)
    assert len(fitted) > 1 and max(fitted) < 9


def grown_plainly(bins, w, y, levels):
    gains = np.zeros(len(bins))

    def spread(at):
        return np.average((y[at] - np.average(y[at], weights=w[at])) ** 2, weights=w[at])

    def grow(at, left):
        found = (0.0, None, None)
        for f, b in enumerate(bins):
            for cut in np.unique(b[at])[:-1]:
                low, high = at[b[at] <= cut], at[b[at] > cut]
                inside = (w[low].sum() * spread(low) + w[high].sum() * spread(high)) / w[at].sum()
                found = max(found, (spread(at) - inside, f, cut), key=lambda x: x[0])
        if left and found[0] > 1e-12:
            gain, f, cut = found
            gains[f] += gain * w[at].sum()
            grow(at[bins[f][at] <= cut], left - 1)
            grow(at[bins[f][at] > cut], left - 1)

    grow(np.arange(len(w)), levels)
    return gains


@pytest.mark.parametrize("levels", [1, 3, 30])
def test_growth_against_a_plain_tree(levels):
    random = np.random.default_rng(5)
    bins = np.stack([random.integers(0, m, 150) for m in (32, 5, 2)]).astype(np.uint8)
    w, y = random.integers(1, 4, 150).astype(float), 1e6 + random.normal(size=150)
    want = grown_plainly(bins, w, y, levels)
    which, distinct = forest._distinct(np.ascontiguousarray(bins.T))
    sums = np.stack([np.bincount(which, x) for x in (w, w * (y - 1e6), w * (y - 1e6) ** 2)])
    found = forest.grown_gains(distinct, sums, levels)
    # in small nodes features tie; the sum does not depend on them where all rows are told apart
    assert found.sum() == pytest.approx(want.sum(), rel=1e-8)
    assert levels == 30 or found == pytest.approx(want, rel=1e-8)
    assert (distinct[:, which] == bins).all()


def test_no_gain_without_a_split():
    alone = np.array([[1.0], [2.0], [4.0]])
    assert list(forest.grown_gains(np.zeros((2, 1), np.uint8), alone, 30)) == [0.0, 0.0]
    assert list(forest.grown_gains(np.zeros((2, 0), np.uint8), np.zeros((3, 0)), 30)) == [0.0, 0.0]


def test_edges_count_the_zeros():
    assert list(forest.column_edges(np.zeros(5), 5, 31)) == []
    assert list(forest.column_edges(np.array([0.0, 0.0, 2.0, -4.0]), 4, 31)) == [-2.0, 1.0]
    assert list(forest.column_edges(np.arange(1.0, 9.0), 8, 3)) == [2.5, 4.5, 6.5]
