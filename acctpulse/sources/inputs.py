"""Logical inputs of the account-health operators, derived from the given tables.

Amounts are kept in quarter units (multiples of 0.25), so sums are exact in
floating point whatever order they are added in.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.functions import month_start, week_close_after
from acctpulse.session import DEALT_MB, materialize_dealt, parts_for, spread
from acctpulse.sources.tables import read_table

OPEN_END = date(9999, 12, 31)
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def quarters(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 4) / 4.0


def _d(text: str) -> Column:
    return F.lit(date.fromisoformat(text))


def _when(*pairs: tuple[Column, Column], default: Column | None = None) -> Column:
    out = F.when(*pairs[0])
    for cond, value in pairs[1:]:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


class Inputs:
    """Lazily built logical inputs over one directory of parquet tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self.parts: int | None = None
        self._orders: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)

    def dealt_by_account(self) -> Inputs:
        """The same inputs over dated orders that are written once, dealt by account.

        What is derived from orders alone and grouped by account needs no shuffle then.
        """
        dealt = Inputs(self.spark, self.directory)
        dealt.parts = parts_for(self.table("lineitem"), self.table("orders"), self.table("part"), mb=DEALT_MB)
        dealt._orders = materialize_dealt(self.dated_orders(), "dated_orders", dealt.parts, "account_id")
        return dealt

    def _by(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` dealt by ``key``, where these inputs are dealt."""
        return df.repartition(self.parts, key) if self.parts else df

    # -- orders with a report date ------------------------------------------------

    def dated_orders(self) -> DataFrame:
        """Orders whose report date is the day, the month end or the closing Sunday."""
        if self._orders is not None:
            return self._orders
        day = F.to_date("o_orderdate")
        kind = F.col("o_orderkey") % 3
        return self.table("orders").select(
            "o_orderkey",
            F.col("o_custkey").alias("account_id"),
            day.alias("order_dt"),
            _when((kind == 0, F.last_day(day)), (kind == 1, week_close_after(day)), default=day).alias(
                "report_dt"
            ),
            quarters("o_totalprice").alias("amount"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
        )

    # -- account panel ------------------------------------------------------------

    def account_daily(self) -> DataFrame:
        """One row per account and report date."""
        urgent, status = F.substring("priority", 1, 1), F.col("status")

        def part(cond: Column, name: str, scale: float = 1.0) -> Column:
            return F.sum(F.when(cond, F.col("amount") * scale)).alias(name)

        facts = (
            self.dated_orders()
            .groupBy("account_id", "report_dt")
            .agg(
                F.sum("amount").alias("amount_month"),
                F.max("amount").alias("run_rate"),
                F.count(F.lit(1)).cast("double").alias("core_users"),
                F.sum(F.when(status == "F", F.lit(1.0))).alias("full_users"),
                part(urgent == "1", "ingest_amt"),
                part(urgent == "2", "us_ingest_amt"),
                part(urgent == "3", "eu_ingest_amt"),
                part(urgent == "1", "ingest_price", 0.25),
                part(urgent == "2", "us_ingest_price", 0.25),
                part(urgent == "3", "eu_ingest_price", 0.25),
                part(status == "O", "us_ccu_amt"),
                part(status == "F", "us_core_ccu_amt"),
                part(status == "P", "us_advanced_ccu_amt"),
                part(urgent == "4", "eu_ccu_amt"),
                part(urgent == "5", "eu_core_ccu_amt"),
                part((status == "O") & (urgent == "1"), "eu_advanced_ccu_amt"),
                part(status == "O", "us_ccu_price", 0.5),
                part(status == "F", "us_core_ccu_price", 0.5),
                part(status == "P", "us_advanced_ccu_price", 0.5),
                part(urgent == "4", "eu_ccu_price", 0.5),
                part(urgent == "5", "eu_core_ccu_price", 0.5),
                part((status == "O") & (urgent == "1"), "eu_advanced_ccu_price", 0.5),
                part(status == "F", "full_user_amt", 2.0),
                part(status == "O", "core_user_amt", 2.0),
                part(status == "F", "full_user_price", 0.125),
                part(status == "O", "core_user_price", 0.125),
                F.min(urgent.cast("int")).alias("lowest_priority"),
                F.max(urgent.cast("int")).alias("highest_priority"),
            )
            .withColumns(
                {
                    c: F.array(*[F.lit(p) for p in PRIORITIES])[F.col(c) - 1]
                    for c in ("lowest_priority", "highest_priority")
                }
            )
        )
        k = F.col("account_id")
        d = F.col("report_dt")
        segment = F.col("c_mktsegment")
        accounts = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("account_id"),
                F.col("c_name").alias("account_name"),
                "c_mktsegment",
                "c_acctbal",
                F.col("n_name").alias("country"),
                F.col("r_name").alias("geo"),
                F.col("c_nationkey").cast("int").alias("sub_region"),
            )
        )
        joined = facts.join(accounts, "account_id")
        parent = F.when(k % 10 == 9, k - 1).otherwise(k)
        term_end = _term_end(k)
        low = F.col("lowest_priority")
        return joined.select(
            "account_id",
            parent.alias("effective_account_id"),
            k.alias("crm_account_id"),
            "account_name",
            "report_dt",
            _when(
                (k % 8 == 7, _d("2001-03-15")),
                ((k % 3 == 0) & (d >= _d("1998-01-01")), _d("1998-01-01")),
                default=_d("1995-01-15"),
            ).alias("term_start"),
            term_end.alias("term_end"),
            F.when(k % 2 == 0, _d("1994-06-30")).otherwise(_d("1995-01-15")).alias("contract_start"),
            _when(
                (k % 10 == 5, F.lit(OPEN_END)), (k % 5 == 0, _d("2002-06-30")), default=term_end
            ).alias("renewal_dt"),
            _program(segment).alias("program"),
            F.when(k % 7 == 0, F.lit(0.0)).otherwise(quarters("c_acctbal")).alias("acr"),
            F.when(k % 4 == 0, "Y").otherwise("N").alias("multiyear_flag"),
            segment.alias("industry"),
            "country",
            "geo",
            F.concat("geo", F.lit("/"), "country").alias("region"),
            "sub_region",
            (k % 5000).cast("int").alias("employees"),
            F.when((k % 6 == 1) & (d >= _d("2000-01-01")), "Y").otherwise("N").alias("churn_indicator"),
            *[c for c in facts.columns if c not in _FACT_KEYS],
            F.when(k % 4 != 0, (k % 3).cast("double")).alias("min_core_users"),
            F.when(k % 6 != 0, (k % 2).cast("double")).alias("min_full_users"),
            (k % 300 * 1000).cast("double").alias("min_commit"),
            (F.col("amount_month") * 3).alias("ctd_amount"),
            (F.col("amount_month") * 2).alias("qtd_amount"),
            (F.col("amount_month") * 4).alias("ytd_amount"),
            F.col("amount_month").alias("mtd_amount"),
            _when(
                (parent % 13 == 0, F.lit("SELF_SERVE")),
                ((parent % 6 == 1) & (d >= _d("1999-06-01")), F.lit("Cancelled Account")),
                default=F.lit("SALES_LED"),
            ).alias("sales_channel"),
            (k % 11 == 0).alias("exclusion_flag"),
            F.when(k % 3 != 0, quarters("c_acctbal")).alias("act_acr"),
            F.when(k % 4 != 3, k % 4 == 1).alias("is_data_plus"),
            F.when(k % 5 != 4, k % 5 == 1).alias("is_savings_rollover"),
            F.when(low == "4-NOT SPECIFIED", "NOT APPLICABLE")
            .when(low != "5-LOW", low)
            .alias("temperature"),
            _when(
                (F.col("highest_priority") == "4-NOT SPECIFIED", F.lit("Unknown")),
                (F.col("highest_priority") == "1-URGENT", F.lit("NOT UPDATED")),
                default=F.col("highest_priority"),
            ).alias("sentiment_rating"),
            (k % 5 != 3).alias("paid_account_flag"),
            (k % 2 == 0).alias("is_paid_users_eligible"),
            F.when(k % 3 == 0, "CCU").alias("monetize_type"),
        )

    def account_day_gaps(self) -> DataFrame:
        """Day-scale panel with missing days, from the event stream."""
        return (
            self.table("events")
            .groupBy(F.col("user_id").alias("account_id"), F.to_date("ts").alias("report_dt"))
            .agg(
                F.sum(F.when(F.col("event_type") == "view", 1.0)).alias("core_users"),
                F.sum(F.when(F.col("event_type") == "click", 1.0)).alias("full_users"),
                F.sum(quarters("value")).alias("amount_month"),
            )
        )

    def account_month_end(self) -> DataFrame:
        return self.dated_orders().groupBy(
            "account_id", F.last_day("order_dt").alias("report_dt")
        ).agg(F.sum("amount").alias("amount_month"))

    # -- product usage --------------------------------------------------------------

    def feature_flags_monthly(self) -> DataFrame:
        p, s, a = F.col("priority"), F.col("status"), F.col("amount")
        return (
            self.dated_orders()
            .groupBy("account_id", month_start("order_dt").alias("month"))
            .agg(
                F.max(F.when(p == "1-URGENT", 1)).alias("f_urgent"),
                F.max(F.when(p == "2-HIGH", 1).otherwise(0)).alias("f_high"),
                F.max(F.when((s == "F") & (a > 100000), 1).when(s == "F", 0)).alias("f_large"),
                F.max(F.when(p == "3-MEDIUM", 1)).alias("f_medium"),
                F.max(F.when(p == "5-LOW", 1).when(s == "O", 0)).alias("f_low"),
            )
        )

    def _order_lines(self) -> DataFrame:
        lines = self.table("lineitem").join(
            self.dated_orders(), F.col("l_orderkey") == F.col("o_orderkey")
        )
        return lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))

    def feature_usage_daily(self) -> DataFrame:
        line = F.col("l_linenumber") % 3
        # What is made of lines alone is made before they are shuffled, where it is narrower.
        lines = self.table("lineitem").select(
            "l_orderkey",
            "l_partkey",
            _when(
                (line == 0, F.lit("FULL_PLATFORM")), (line == 1, F.lit("CORE")), default=F.lit("BASIC")
            ).alias("tier"),
            (F.col("l_suppkey") % 7).cast("string").alias("user_id"),
            F.when(F.col("l_linestatus") == "O", "us").otherwise("eu").alias("datacentre"),
            (F.col("l_quantity") > 5).alias("daily_active"),
            F.when(F.col("l_discount") > 0.08, "UnbilledCCU").otherwise("BilledCCU").alias("metric"),
        )
        orders = self.dated_orders().select("o_orderkey", "account_id", F.col("report_dt").alias("date"))
        parts = self.table("part").select(
            "p_partkey", F.concat("p_brand", F.lit(" "), "p_type").alias("capability")
        )
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select("date", "account_id", "capability", "tier", "user_id", "datacentre", "daily_active", "metric")
        )

    def account_flags_daily(self) -> DataFrame:
        k = F.col("account_id")
        return self.dated_orders().select(F.col("report_dt").alias("date"), "account_id").dropDuplicates().select(
            "date",
            "account_id",
            (k % 5 != 3).alias("paid_account_flag"),
            F.when(k % 9 != 0, k % 2 == 0).alias("paid_user_eligible"),
        )

    def account_metrics_daily(self) -> DataFrame:
        k = F.col("account_id")
        return (
            self.dated_orders()
            .filter(F.col("status") != "P")
            .select(F.col("report_dt").alias("date"), "account_id")
            .dropDuplicates()
            .select("date", "account_id", (k % 7 < 3).alias("qbp_eligible"))
        )

    def capability_consumption_daily(self) -> DataFrame:
        k = F.col("account_id")
        return self._order_lines().select(
            F.when(k % 4 != 0, k).alias("primary_account_id"),
            k.alias("fallback_account_id"),
            F.col("order_dt").alias("usage_date"),
            _capability_label(F.col("p_type")).alias("capability"),
        )

    def consumption_daily(self) -> DataFrame:
        k = F.col("account_id")
        lines = self.table("lineitem").join(
            self.dated_orders(), F.col("l_orderkey") == F.col("o_orderkey")
        )
        return lines.select(
            F.when(k % 4 != 0, k).alias("primary_account_id"),
            k.alias("fallback_account_id"),
            F.col("order_dt").alias("usage_date"),
            F.when(F.col("l_returnflag") != "R", "GigabytesIngested").otherwise("Other").alias("metric"),
            F.col("l_quantity").alias("gb"),
        )

    def activity(self, line_status: str) -> DataFrame:
        lines = self.table("lineitem").filter(F.col("l_linestatus") == line_status)
        return lines.join(self.dated_orders(), F.col("l_orderkey") == F.col("o_orderkey")).select(
            "account_id", F.col("order_dt").alias("date")
        )

    def logs_weekly(self) -> DataFrame:
        return (
            self.dated_orders()
            .groupBy("account_id", F.trunc("order_dt", "week").alias("week"))
            .agg(
                F.sum(F.when(F.col("status") != "O", F.col("amount"))).alias("api_logs_gb"),
                F.sum(F.when(F.col("status") != "P", F.col("amount"))).alias("app_logs_gb"),
            )
        )

    def subscription_flags_daily(self) -> DataFrame:
        k = F.col("account_id")
        rows = self.dated_orders().select("account_id", "report_dt").dropDuplicates()
        return rows.select(
            "account_id",
            "report_dt",
            *[
                F.when(k % (i + 3) != 0, k % (i + 2) == 1).alias(name)
                for i, name in enumerate(SUBSCRIPTION_FLAGS)
            ],
        )

    def account_hierarchy(self) -> DataFrame:
        c = self.table("customer")
        first = c.select(
            F.col("c_custkey").alias("account_id"),
            (F.col("c_custkey") % 100).alias("billing_account_id"),
            _d("1995-01-01").alias("eff_start"),
            _d("1997-12-31").alias("eff_end"),
        )
        second = c.select(
            F.col("c_custkey").alias("account_id"),
            (F.col("c_nationkey") + 1000).cast("long").alias("billing_account_id"),
            _d("1998-01-01").alias("eff_start"),
            F.lit(OPEN_END).alias("eff_end"),
        )
        return first.unionByName(second)

    def competitors(self, line_status: str) -> DataFrame:
        """Daily counters of one region."""
        lines = self.table("lineitem").filter(F.col("l_linestatus") == line_status)
        t = F.col("p_type")
        typed = lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_suppkey").alias("account_id"), F.to_date("l_shipdate").alias("date"), "p_type"
        )
        return (
            spread(typed, "account_id", "date")
            .groupBy("account_id", "date")
            .agg(
                F.sum(F.when(t == "ECONOMY", 1).otherwise(0)).alias("comp_a"),
                F.sum(F.when(t == "SMALL", 1).otherwise(0)).alias("comp_b"),
                F.sum(F.when(t == "PROMO", 1)).alias("comp_c"),
            )
        )

    # -- support, scores, invoices, contracts ------------------------------------------

    def support_cases(self) -> DataFrame:
        # Lines are reduced per order before the join, so the case grain is never multiplied.
        shipped = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
        )
        o = self.table("orders")
        key = F.col("o_orderkey")
        cases = o.join(shipped, key == F.col("l_orderkey"), "left")
        return (
            self._by(cases, "o_custkey")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                key.alias("case_id"),
                F.col("o_custkey").alias("account_id"),
                F.col("c_name").alias("account_name"),
                F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("priority"),
                F.col("o_orderdate").alias("created_ts"),
                F.when(F.col("o_orderstatus") != "P", F.col("last_ship")).alias("solved_ts"),
                F.when(key % 3 != 0, F.col("first_ship")).alias("first_response_ts"),
                F.when(key % 4 != 0, (key % 5 + 1).cast("double")).alias("csat"),
            )
        )

    def case_history(self) -> DataFrame:
        return (
            self._by(self.table("lineitem"), "l_orderkey")
            .groupBy(
                F.col("l_orderkey").alias("case_id"),
                F.when(F.col("l_linestatus") == "O", "Priority").otherwise("Status").alias("field"),
                F.col("l_shipdate").alias("created_ts"),
            )
            .agg(F.min(F.concat(F.lit("P"), F.col("l_linenumber").cast("string"))).alias("old_value"))
        )

    def score_weekly(self) -> DataFrame:
        return (
            self.dated_orders()
            .groupBy("account_id", week_close_after("order_dt").alias("date"))
            .agg(
                (F.max("amount") / 524288).alias("churn_risk_score"),
                (F.min("amount") / 524288).alias("sentiment_score"),
                (F.count(F.lit(1)) / 4).alias("engagement_score"),
            )
        )

    def invoices(self) -> DataFrame:
        d = F.col("order_dt")
        return self.dated_orders().select(
            "account_id",
            F.col("account_id").alias("entity_id"),
            d.alias("due_dt"),
            F.when(F.col("status") != "O", F.date_add(d, 30)).alias("closed_dt"),
            "amount",
            "status",
            F.col("o_orderkey").alias("transaction_id"),
            (F.col("o_orderkey") % 50 == 0).alias("deleted"),
        )

    def invoice_customers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 40 == 0).alias("deleted")
        )

    def contract_terms(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("account_id"),
            F.col("c_mktsegment").alias("program"),
            F.col("c_acctbal").alias("acr"),
            _d("1995-01-15").alias("term_start"),
            _term_end(k).alias("term_end"),
        )

    def acr_change(self) -> DataFrame:
        k = F.col("account_id")
        change = F.when(F.col("status") == "F", F.col("amount") * -0.25).otherwise(
            F.col("amount") * 0.125
        )
        summed = self.dated_orders().groupBy("account_id", F.col("order_dt").alias("report_dt")).agg(
            F.sum("amount").alias("acr_now"), F.sum(change).alias("acr_change")
        )
        return summed.withColumn(
            "change_class",
            F.when((F.col("acr_change") < 0) & (k % 2 == 0), DOWNGRADE_CLASSES[0])
            .when(F.col("acr_change") < 0, DOWNGRADE_CLASSES[1])
            .otherwise("EXPANSION"),
        )

    def weekly_usage(self) -> DataFrame:
        return (
            self.dated_orders()
            .groupBy("account_id", week_close_after("order_dt").alias("close_week"))
            .agg(
                F.count_distinct("priority").alias("n_capabilities"),
                F.max("amount").alias("run_rate"),
            )
        )

    def metric_panel(self) -> DataFrame:
        """Account-month rows with the scored metrics, as the wide panel would hold them."""
        k, n, a = F.col("account_id"), F.col("n"), F.col("a")
        facts = (
            self.dated_orders()
            .groupBy("account_id", F.last_day("order_dt").alias("report_dt"))
            .agg(
                F.sum("amount").alias("a"),
                F.min("amount").alias("lowest"),
                F.max("amount").alias("highest"),
                F.count(F.lit(1)).alias("n"),
                F.count_if(F.col("priority") == "1-URGENT").alias("n_p1"),
                F.count_if(F.col("priority").isin("1-URGENT", "2-HIGH")).alias("n_p12"),
                F.count_if(F.col("status") == "F").alias("n_f"),
                F.count_if(F.col("status") == "O").alias("n_open"),
                F.sum(F.when(F.col("status") == "O", F.col("amount"))).alias("open_amount"),
            )
        )
        customer = self.table("customer").select(
            F.col("c_custkey").alias("account_id"), F.col("c_name").alias("account_name"), "c_mktsegment"
        )

        def quarter_steps(c: Column, step: int) -> Column:
            return F.floor(c / step) / 4

        metrics = {
            "product_stickiness_ratio": F.when(k % 17 != 0, n * 12.5),
            "user_stickiness_ratio": quarter_steps(a, 1000),
            "user_activation_percentage": F.when(k % 19 != 0, quarter_steps(a, 2000)),
            "product_utilization_rate": quarter_steps(F.col("lowest"), 4000),
            "revenue_growth": quarter_steps(a - 250000, 1000),
            "revenue_growth_score": k % 101,
            "renewal_urgency_months": F.when(k % 3 == 0, k % 24 / 4),
            "overage_score": F.when(k % 4 == 1, quarter_steps(a, 50000)),
            "contract_length_score": F.when(k % 5 != 0, k % 5 * 25),
            "pct_p1_cases": F.when(n > 1, F.col("n_p1") * 25),
            "pct_p1p2_cases": F.when(n > 1, F.col("n_p12") * 25),
            "resolution_rate": F.when(k % 6 != 0, F.col("n_f") / 4),
            "open_tickets": F.when(k % 6 != 0, n),
            "avg_csat_score": F.when(k % 7 < 5, k % 5 + 1),
            "mthly_fttr_50": F.when(F.col("n_p1") > 0, quarter_steps(F.col("highest"), 1000)),
            "churn_risk_score": k % 100 / 100,
            "sentiment_score": F.when(k % 8 != 0, k % 50 / 50),
            "engagement_score": F.when(k % 8 != 0, k % 20 / 20),
            "maximum_days_past_due": F.when(k % 3 != 0, F.col("n_open") * 30),
            "sum_total_amount_due": F.col("open_amount"),
        }
        segment = F.col("c_mktsegment")
        return facts.join(customer, "account_id").select(
            "account_id",
            "account_name",
            "report_dt",
            F.when(k % 8 == 7, _d("2001-03-15")).otherwise(_d("1995-01-15")).alias("term_start"),
            _program(segment).alias("latest_program"),
            *[c.cast("decimal(18,2)").alias(name) for name, c in metrics.items()],
            quarter_steps(a - 250000, 3000).alias("pct_m_plus_6_bcm"),
        )

    def model_rows(self) -> DataFrame:
        """Numeric line columns per return flag, as regression input."""
        return self.table("lineitem").select(
            F.col("l_returnflag").alias("segment_name"),
            F.col("l_quantity").alias("quantity"),
            F.when(F.col("l_tax") > 0.01, F.round(F.col("l_tax") * 100)).alias("tax_pct"),
            F.round(F.col("l_discount") * 100).alias("discount_pct"),
            F.col("l_linenumber").cast("double").alias("line_no"),
            quarters("l_extendedprice").alias("target"),
        )


SUBSCRIPTION_FLAGS = (
    "is_paid_ingest_eligible",
    "is_paid_users_eligible",
    "is_paid_account_eligible",
    "is_tiered_pricing",
    "is_paid_synthetics_eligible",
    "is_paid_qbp_eligible",
    "is_ccu_account",
)

# Change classes that count as a downgrade.
DOWNGRADE_CLASSES = ("EXISTING BUSINESS - DOWNGRADE", "LATE RENEWAL - DOWNGRADE")

_FACT_KEYS = ("account_id", "report_dt", "lowest_priority", "highest_priority")


def _term_end(k: Column) -> Column:
    return _when(
        (k % 5 == 0, F.lit(OPEN_END)),
        (k % 5 == 1, _d("1995-12-31")),
        (k % 5 == 2, _d("1997-01-01")),
        (k % 5 == 3, _d("1998-01-31")),
        default=_d("2001-07-31"),
    )


def _program(segment: Column) -> Column:
    return _when(
        (segment == "BUILDING", F.lit("Volume Plan")),
        (segment == "AUTOMOBILE", F.lit("Savings Plan")),
        (segment == "MACHINERY", F.lit("PAYG")),
        (segment == "HOUSEHOLD", F.lit("Volume Plan Legacy")),
        default=F.lit("Enterprise"),
    )


def _capability_label(t: Column) -> Column:
    return _when(
        (t == "ECONOMY", F.lit("Errors Inbox")),
        (t == "SMALL", F.lit("Logs")),
        (t == "PROMO", F.lit("Dashboards")),
        (t == "STANDARD", F.lit("Synthetics")),
        (t == "MEDIUM", F.lit("Kubernetes")),
        default=F.lit("Something Else"),
    )
