from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from acctpulse.operators.assembly import dealt_join, lag_lists, stack_join
from acctpulse.operators.lags import lag_features, lag_join
from acctpulse.plans import usage

D = date(2024, 3, 3)


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def sides(spark):
    base = spark.range(60).select(
        F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("a"),
        F.when(F.col("id") % 11 != 0, F.lit(D)).alias("d"),
        (F.col("id") % 3).alias("x.y"),
    )
    one = spark.range(4).select(F.col("id").alias("a"), F.lit(D).alias("d"), (F.col("id") * 10).alias("one"))
    many = spark.range(12).select(
        F.when(F.col("id") != 11, F.col("id") % 3).alias("a"),
        F.lit(D).alias("d"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("many"),
        F.lit("s").alias("label"),
    )
    return base, one, many


def test_stack_equals_left_joins_with_repeated_rows_and_null_keys(spark):
    base, one, many = sides(spark)
    joined = base.join(one, ["a", "d"], "left").join(many, ["a", "d"], "left").select("a", "d", "`x.y`", "one", "many", "label")
    assert counted(stack_join(base, ["a", "d"], one, many, distinct=False)) == counted(joined)
    got = stack_join(base.dropDuplicates(), ["a", "d"], one, many)
    assert counted(got) == counted(joined.dropDuplicates())


@pytest.mark.parametrize("distinct", [True, False])
def test_dealt_join_equals_stack(spark, distinct):
    base, one, many = sides(spark)
    base = base.dropDuplicates()
    got = dealt_join(base, ["a", "d"], one, many, distinct=distinct)
    want = stack_join(base, ["a", "d"], one, many, distinct=distinct)
    assert got.columns == want.columns
    assert counted(got) == counted(want)
    with pytest.raises(ValueError, match="one"):
        dealt_join(base, ["a", "d"], one, one)
    zeros = one.limit(1).withColumn("one", F.lit(-0.0))
    assert {str(r["one"]) for r in dealt_join(zeros.select("a", "d"), ["a", "d"], zeros, distinct=distinct).collect()} == {"-0.0"}


def test_stack_of_empty_sides(spark):
    base, one, many = sides(spark)
    assert stack_join(base.limit(0), ["a", "d"], one, many).count() == 0
    out = stack_join(base, ["a", "d"], one.limit(0), many.limit(0))
    assert out.count() == 60 and out.filter("one is not null or label is not null").count() == 0


def test_stack_refuses_a_name_used_twice(spark):
    base, one, _ = sides(spark)
    with pytest.raises(ValueError, match="one"):
        stack_join(base, ["a", "d"], one, one)


def test_rows_without_a_key_are_spread_by_content(spark):
    base = spark.range(2000).select(F.lit(None).cast("long").alias("a"), F.lit(D).alias("d"), F.col("id").alias("x"))
    one = spark.createDataFrame([(1, D, 2)], "a long, d date, one long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = stack_join(base, ["a", "d"], one).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in sizes) < 1000


def test_lag_lists_fan_out_like_one_join_per_lag(spark):
    weeks = [D + timedelta(days=7 * k) for k in range(30)]
    spine = spark.createDataFrame(
        [(a, w) for a in (1, 2, None) for w in weeks] + [(1, weeks[5]), (2, None)], "account_id long, close_week date"
    )
    rows = [(1, w, float(k % 3)) for k, w in enumerate(weeks)] + [(1, weeks[4], 9.0), (1, weeks[4], 9.0), (1, weeks[1], None)]
    logs = spark.createDataFrame(rows + [(None, weeks[3], 5.0), (2, weeks[0], None)], "account_id long, close_week date, v double")
    single = spark.createDataFrame([(1, weeks[2], 7)], "account_id long, close_week date, s int")
    want = lag_join(lag_features(spine, (single, {"s": (0, 4)})), logs, "v", (0, 4, 8))
    got = lag_lists(spine, [(single, {"s": (0, 4)})], [(logs, ("v",), (0, 4, 8))]).select(*want.columns)
    assert counted(got) == counted(want)


def test_several_columns_of_a_repeating_source_stay_together(spark):
    spine = spark.createDataFrame([(1, D), (3, D)], "account_id long, close_week date")
    flags = spark.createDataFrame([(1, D, 1, 2), (1, D, 3, None)], "account_id long, close_week date, p int, q int")
    got = counted(lag_lists(spine, [], [(flags, ("p", "q"), (0,))]))
    assert got == Counter([(1, D, 1, 2), (1, D, 3, None), (3, D, None, None)])


def test_reach_counts_accounts_once_and_keeps_capabilities_without_any(spark):
    rows = [(D, 1, "a"), (D, 1, "a"), (D, 2, "a"), (D, 2, "b"), (D, None, "c"), (D, 3, None)]
    used = spark.createDataFrame(rows, "date date, account_id long, capability string").withColumn("tier", F.lit("CORE"))
    got = {r.capability: (r.account_count, r.total_accounts) for r in usage.capability_reach(used, date(2024, 4, 1)).collect()}
    assert got == {"a": (2, 3), "b": (1, 3), "c": (0, 3), None: (1, 3)}
