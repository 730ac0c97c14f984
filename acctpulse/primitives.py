"""Single relational constructs as queries, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acctpulse.functions import (
    days_between,
    dec0,
    dec2,
    div0,
    flag01,
    greatest_strict,
    least_strict,
    minute_diff,
    month_diff,
    month_start,
    or_na,
    previous_month_end,
    safe_div,
    week_close_after,
    week_close_before,
    year_diff,
)
from acctpulse.operators.lags import lag_join
from acctpulse.operators.latest import latest_slice, month_end_or, newest, top_row
from acctpulse.operators.quantiles import exact_quantiles
from acctpulse.operators.reshape import (
    distinct_list,
    presence_flags,
    unpivot_drop_nulls,
    unpivot_keep_nulls,
)
from acctpulse.operators.rolling import forward_values, latest_value, prior_avg, rolling_avg, running_sum
from acctpulse.sources.inputs import Inputs
from acctpulse.sources.tables import run_query

AS_OF = date(2001, 8, 1)
PRIMITIVES: dict[str, Callable] = {}


def primitive(build: Callable[[Inputs], DataFrame]):
    PRIMITIVES[build.__name__] = lambda spark, directory: build(Inputs(spark, directory))
    return build


# -- projection and filters -------------------------------------------------------------------


@primitive
def scan_project_filter(i):
    d = F.to_date("o_orderdate")
    return (
        i.table("orders")
        .filter(
            (F.col("o_totalprice") > 1000)
            & F.col("o_orderdate").between(F.lit("1995-06-01"), F.lit("2001-06-30"))
            & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")
            & (F.col("o_orderstatus") != "P")
        )
        .withColumn("order_dt", d)
        .drop("o_orderdate", "o_orderpriority")
        .withColumnRenamed("o_orderkey", "order_id")
        .withColumn("weights", F.lit(0))
    )


@primitive
def like_filters(i):
    name = F.col("p_name")
    return (
        i.table("part")
        .filter(name.like("%ring%") | (name.ilike("RED%") & ~F.lower("p_type").ilike("%promo%")))
        .select("p_partkey", "p_name", F.lower("p_type").alias("type_lower"))
    )


@primitive
def null_filters_flags(i):
    return (
        i.invoices()
        .filter(F.col("closed_dt").isNull() & ~F.col("deleted"))
        .select(
            "transaction_id",
            flag01(F.when(F.col("amount") > 100000, True)).alias("is_large"),
            or_na(F.when(F.col("account_id") % 3 != 0, F.col("status")), "P").alias("status_or_na"),
        )
    )


@primitive
def month_end_filter(i):
    p = i.dated_orders().select("o_orderkey", "account_id", "report_dt")
    return month_end_or(p, "report_dt", newest(p, "report_dt"))


# -- joins ----------------------------------------------------------------------------------------


@primitive
def join_left_equi(i):
    terms = i.contract_terms().select("account_id", "program", "acr")
    return i.support_cases().select("case_id", "account_id", "priority").join(terms, "account_id", "left")


@primitive
def join_inner_equi(i):
    alive = i.invoice_customers().filter(~F.col("deleted")).select("customer_id")
    return (
        i.invoices()
        .filter(~F.col("deleted"))
        .select("transaction_id", "entity_id", "amount")
        .join(alive, F.col("entity_id") == F.col("customer_id"), "inner")
    )


@primitive
def join_computed_key(i):
    """Cases against the month-end amount of their month and of the month before."""
    c = i.support_cases().select("case_id", "account_id", F.to_date("created_ts").alias("d"))
    m = i.account_month_end()
    now = m.select("account_id", month_start("report_dt").alias("month"), F.col("amount_month").alias("amount_now"))
    before = m.select("account_id", F.col("report_dt").alias("prior_end"), F.col("amount_month").alias("amount_before"))
    return (
        c.withColumns({"month": month_start("d"), "prior_end": previous_month_end("d")})
        .join(now, ["account_id", "month"], "left")
        .join(before, ["account_id", "prior_end"], "left")
    )


@primitive
def join_band(i):
    """Days of the account at most 10 days back: a band self-join, as a RANGE frame.

    No pairs are formed; a frame holds at most 11 days of one account.
    """
    a = i.account_day_gaps().withColumn("day_no", F.unix_date("report_dt"))
    band = Window.partitionBy("account_id").orderBy("day_no").rangeBetween(-10, Window.currentRow)
    return a.select(
        "account_id",
        "report_dt",
        F.count("amount_month").over(band).alias("days"),
        F.sum("amount_month").over(band).alias("amount_11d"),
    )


@primitive
def join_theta(i):
    """Every month against the account's months so far, accumulated instead of paired."""
    upto = (
        Window.partitionBy("account_id")
        .orderBy("report_dt")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return i.account_month_end().select(
        "account_id",
        "report_dt",
        F.sum("amount_month").over(upto).alias("amount_to_date"),
        F.max("amount_month").over(upto).alias("highest_to_date"),
    )


@primitive
def join_one_sided_range(i):
    last = i.weekly_usage().groupBy("account_id").agg(F.max("close_week").alias("last_week"))
    last = last.alias("l")
    u = i.weekly_usage().alias("u")
    cond = (F.col("u.account_id") == F.col("l.account_id")) & (
        F.col("l.last_week") >= F.date_add("u.close_week", 28)
    )
    return u.join(last, cond, "left").select("u.*", "last_week")


@primitive
def join_scd2(i):
    """Weekly usage under each hierarchy version that overlaps its week."""
    u, h = i.weekly_usage().alias("u"), i.account_hierarchy().alias("h")
    cond = (
        (F.col("u.account_id") == F.col("h.account_id"))
        & (F.col("h.eff_start") <= F.col("u.close_week"))
        & (F.col("h.eff_end") >= F.date_sub("u.close_week", 6))
    )
    return u.join(h, cond, "left").select("u.account_id", "close_week", "run_rate", "billing_account_id")


@primitive
def join_scd2_fanout(i):
    return i.weekly_usage().join(
        i.account_hierarchy().select("account_id", "billing_account_id"), "account_id", "left"
    )


@primitive
def join_lag(i):
    u = i.weekly_usage().select("account_id", "close_week", "run_rate")
    spine = u.select("account_id", "close_week")
    return lag_join(spine, u, "run_rate", (0, 1, 2, 4, 8))


@primitive
def cross_join_scalar(i):
    """A one-row aggregate next to every row, as scalar subqueries."""
    u = i.weekly_usage()
    return u.select(
        "account_id",
        "close_week",
        (F.col("run_rate") / newest(u, "run_rate")).alias("share"),
        (F.col("close_week") < newest(u, "close_week")).alias("is_before_last"),
    )


# -- aggregation ----------------------------------------------------------------------------------


@primitive
def group_all_agg(i):
    o = i.dated_orders()
    return o.groupBy("status", "priority", month_start("order_dt").alias("month")).agg(
        F.sum("amount").alias("amount"),
        F.avg("amount").alias("avg_amount"),
        F.min("amount").alias("lowest"),
        F.max("amount").alias("highest"),
        F.count(F.lit(1)).alias("orders"),
    )


@primitive
def group_all_dedup(i):
    return i.dated_orders().select("account_id", "report_dt", "status").dropDuplicates()


@primitive
def having_filter(i):
    grouped = i.dated_orders().groupBy("account_id", month_start("order_dt").alias("month")).agg(
        F.count("priority").alias("assigned"), F.count_if(F.col("priority") == "1-URGENT").alias("urgent")
    )
    return grouped.filter(F.col("assigned") > 1).withColumn(
        "urgent_share", safe_div(F.col("urgent") * F.lit(100.0), F.col("assigned"))
    )


@primitive
def distinct_counts(i):
    u = i.feature_usage_daily()
    return u.groupBy("account_id", "date").agg(
        F.count_distinct("capability").alias("capabilities"),
        F.count_distinct(F.concat("user_id", "datacentre")).alias("users"),
        F.count_distinct(F.when(F.col("tier") != "BASIC", F.col("capability"))).alias("platform_capabilities"),
    )


@primitive
def conditional_agg(i):
    p = F.col("priority")
    return i.support_cases().groupBy("account_id").agg(
        F.sum(F.when(p == "P1", 1).otherwise(0)).alias("p1"),
        F.count_if(p == "P2").alias("p2"),
        F.max(F.when(F.col("solved_ts").isNotNull(), F.col("csat")).otherwise(0.0)).alias("best_solved_csat"),
        F.avg("csat").alias("avg_csat"),
        F.count("csat").alias("rated"),
    )


@primitive
def presence_flags_week(i):
    c = i.competitors("O").unionByName(i.competitors("F"))
    return c.groupBy("account_id", week_close_after("date").alias("close_week")).agg(
        *[
            (F.coalesce(F.sum(x), F.lit(0)) != 0).cast("int").alias(f"is_{x}")
            for x in ("comp_a", "comp_b", "comp_c")
        ]
    )


@primitive
def median_percentiles(i):
    """Exact quantiles of line prices per return flag and over all lines, large groups split."""
    lines = i.table("lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    by_flag = exact_quantiles(lines, ["l_returnflag"], ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.99])
    overall = exact_quantiles(lines, [], ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.99])
    both = by_flag.unionByName(overall.withColumn("l_returnflag", F.lit("all")))
    return both.withColumn("q", F.round("q", 6))


@primitive
def window_percentiles(i):
    """Quartiles of order amounts per status and month, put on every order."""
    o = i.dated_orders().select("o_orderkey", "status", month_start("order_dt").alias("month"), "amount")
    keys = ["status", "month"]
    q = exact_quantiles(o, keys, ["amount"], [0.25, 0.5, 0.75])
    wide = q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    )
    return o.join(wide, keys)


@primitive
def ordered_list_agg(i):
    o = i.dated_orders().select("account_id", month_start("order_dt").alias("month"), "priority")
    return distinct_list(o, ["account_id", "month"], "priority", "priorities")


# -- windows ------------------------------------------------------------------------------------------


@primitive
def rolling_avg_rows(i):
    return rolling_avg(
        i.account_day_gaps(),
        ["account_id"],
        "report_dt",
        {"avg_7": ("amount_month", 7), "avg_30": ("amount_month", 30)},
    ).select("account_id", "report_dt", "avg_7", "avg_30", safe_div("avg_7", F.round("avg_30", 1)).alias("ratio"))


@primitive
def prior_avg_rows(i):
    return prior_avg(i.account_month_end(), ["account_id"], "report_dt", {"prior_3": "amount_month"})


@primitive
def running_sum_rows(i):
    m = i.account_month_end().withColumn("year", F.year("report_dt"))
    return running_sum(
        m, ["account_id", "year"], "report_dt", {"to_date": greatest_strict("amount_month", F.lit(200000.0))}
    )


@primitive
def first_value_latest(i):
    return latest_value(i.account_month_end(), ["account_id"], "report_dt", {"latest_amount": "amount_month"})


@primitive
def lead_n(i):
    steps = {f"ahead_{n}": n for n in (1, 3, 4, 5, 6, 10, 11, 12)}
    return forward_values(i.account_month_end(), ["account_id"], "report_dt", "amount_month", steps)


@primitive
def rank_numbering(i):
    m = i.account_month_end().select("account_id", "report_dt")
    by_month = Window.partitionBy("account_id").orderBy("report_dt")
    by_year = Window.partitionBy("account_id").orderBy(F.year("report_dt"))
    return m.withColumns(
        {"month_no": F.row_number().over(by_month), "year_no": F.dense_rank().over(by_year)}
    )


@primitive
def top_one_per_group(i):
    o = i.dated_orders()
    return top_row(o, ["account_id"], [F.col("amount").desc_nulls_last(), F.col("o_orderkey").asc()]).select(
        "account_id", "o_orderkey", "amount", "priority"
    )


# -- set operations and reshape --------------------------------------------------------------------------


@primitive
def union_all(i):
    return i.competitors("O").select("account_id", "comp_a").unionByName(
        i.competitors("F").select("account_id", "comp_a")
    )


@primitive
def union_distinct(i):
    return i.competitors("O").select("account_id", "comp_a").unionByName(
        i.competitors("F").select("account_id", "comp_a")
    ).dropDuplicates()


_FLAGS = ("f_urgent", "f_high", "f_large", "f_medium", "f_low")


@primitive
def unpivot_drop(i):
    return unpivot_drop_nulls(i.feature_flags_monthly(), ["account_id", "month"], _FLAGS, "metrics", "value")


@primitive
def unpivot_keep(i):
    return unpivot_keep_nulls(i.feature_flags_monthly(), ["account_id", "month"], _FLAGS, "metrics", "value")


@primitive
def binary_pivot(i):
    o = i.dated_orders().select("account_id", month_start("order_dt").alias("month"), "priority")
    return presence_flags(
        o, ["account_id", "month"], "priority", {"is_urgent": "1-URGENT", "is_high": "2-HIGH", "is_low": "5-LOW"}
    )


# -- scalar functions --------------------------------------------------------------------------------------


@primitive
def scalar_numeric(i):
    k, acr = F.col("account_id"), F.col("acr")
    maybe = F.when(k % 4 != 0, (k % 7).cast("double"))
    return i.contract_terms().select(
        "account_id",
        F.coalesce(maybe, F.lit(-1.0)).alias("with_default"),
        safe_div(k * 100.0, k % 7).alias("safe"),
        div0(k, k % 7).alias("zero_safe"),
        greatest_strict(maybe, F.lit(3.0)).alias("larger"),
        least_strict(maybe, F.lit(3.0)).alias("smaller"),
        F.round(k / 8, 1).alias("one_digit"),
        F.round(k / 2, 0).alias("no_digit"),
        F.round(F.log10(1 + k % 7), 9).alias("log10"),
        dec2(k / 8).alias("two_decimals"),
        dec0(k / 2).alias("whole"),
        F.when(acr < 0, "owed").when(acr < 5000, "small").otherwise("large").alias("size"),
        k.cast("string").try_cast("double").alias("as_number"),
        F.col("program").try_cast("double").alias("not_a_number"),
    )


@primitive
def scalar_string(i):
    return i.table("part").select(
        "p_partkey",
        F.concat("p_brand", F.lit(" "), "p_type").alias("label"),
        F.concat("p_brand", F.when(F.col("p_size") > 10, F.col("p_type"))).alias("label_or_null"),
        F.left("p_brand", F.length("p_brand") - F.length(F.lit("#1"))).alias("without_tail"),
        F.lower("p_type").alias("type_lower"),
    )


@primitive
def scalar_dates(i):
    o = i.table("orders")
    ts, d = F.col("o_orderdate"), F.to_date("o_orderdate")
    later = F.date_add(d, (F.col("o_orderkey") % 400).cast("int"))
    stamp = ts.cast("timestamp")
    return o.select(
        "o_orderkey",
        month_start(d).alias("month"),
        F.trunc(d, "week").alias("week"),
        F.last_day(d).alias("month_end"),
        week_close_before(d).alias("sunday_before"),
        week_close_after(d).alias("sunday_after"),
        previous_month_end(d).alias("prior_month_end"),
        F.add_months(d, -30).alias("months_30_ago"),
        F.add_months(F.last_day(d), 1).alias("next_month"),
        F.date_add(d, 28).alias("weeks_4_ahead"),
        month_diff(d, later).alias("months"),
        year_diff(d, later).alias("years"),
        days_between(d, later).alias("days"),
        minute_diff(stamp, later.cast("timestamp")).alias("minutes"),
        F.when(later > F.lit(date(1999, 12, 31)), F.lit(date(9999, 12, 31))).otherwise(later).alias("capped"),
    )


# -- slices, order, query text ------------------------------------------------------------------------------


@primitive
def latest_slice_rows(i):
    return latest_slice(i.weekly_usage(), "close_week")


@primitive
def final_sort(i):
    return i.account_month_end().orderBy(F.desc("report_dt"), F.asc("account_id"))


@primitive
def query_text(i):
    i.table("orders").createOrReplaceTempView("acctpulse_orders")
    return run_query(
        i.spark,
        "SELECT o_orderstatus AS `status`, count(*) AS orders, max(`o_totalprice`) AS highest "
        "FROM acctpulse_orders GROUP BY ALL",
    )
