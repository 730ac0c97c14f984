from datetime import date

from pyspark.sql import functions as F

from acctpulse.operators.reshape import unpivot_drop_nulls, unpivot_keep_nulls
from acctpulse.plans import health
from acctpulse.registry import SCORE_FROM, SCORE_TO
from acctpulse.sources.inputs import Inputs


def test_unpivot_null_modes(rows):
    df = rows("k long, a int, b int", (1, 5, None))
    assert unpivot_keep_nulls(df, ["k"], ["a", "b"], "n", "v").count() == 2
    assert unpivot_drop_nulls(df, ["k"], ["a", "b"], "n", "v").count() == 1


def test_every_metric_has_a_category(spark, data):
    long = health.metric_category(health.metrics_long(Inputs(spark, data).metric_panel()))
    got = {r[0]: r[1] for r in long.groupBy("score_type").agg(F.count_distinct("metric_name")).collect()}
    assert got == {"Adoption_score": 4, "Engagement_score": 3, "Financial_health_score": 6, "Risk_score": 6}


def test_empty_period_scores_without_percentiles(spark, data):
    panel = Inputs(spark, data).metric_panel()
    marks = health.metric_percentiles(panel, date(1900, 1, 1), date(1900, 1, 2))
    assert marks.count() == 1
    r = health.metric_scores(panel.filter("open_tickets is not null"), marks).first()
    assert int(r.open_tickets_hscore) == 50


def test_all_missing_category_is_zero(spark):
    cols = ", ".join(f"cast(null as decimal(38,0)) as {health.score_name(m)}" for m in health.METRICS)
    r = health.category_scores(spark.sql(f"select {cols}")).first()
    assert {r[c] for c in health.CATEGORY_COLUMNS.values()} == {0.0}


def test_side_by_side_unpivot_equals_the_join(spark, data):
    panel = Inputs(spark, data).metric_panel()
    health_rows = health.health_score(panel, SCORE_FROM, SCORE_TO)
    marks = health.metric_percentiles(panel, SCORE_FROM, SCORE_TO)
    scores = health.scores_long(health.category_scores(health.metric_scores(panel, marks)))
    scores = scores.withColumn("metric_name", F.regexp_replace("metric_name_score", "_HSCORE$", ""))
    joined = health.metrics_long(panel).join(scores, [*health.KEY, "metric_name"], "left")
    cols = joined.columns
    assert health_rows.select(cols).exceptAll(joined).count() == 0
    assert joined.exceptAll(health_rows.select(cols)).count() == 0


def test_scores_lie_between_0_and_100(spark, data):
    panel = Inputs(spark, data).metric_panel()
    marks = health.metric_percentiles(panel, SCORE_FROM, SCORE_TO)
    scores = health.metric_scores(panel, marks, rounded=False)
    ranked = [health.score_name(m) for m in health.RANKED]
    r = scores.agg(F.least(*[F.min(c) for c in ranked]), F.greatest(*[F.max(c) for c in ranked])).first()
    assert (r[0], r[1]) == (0.0, 100.0)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner" not in plan.split("Subquery")[0].split("scalar")[0]
