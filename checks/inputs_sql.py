"""The logical inputs as SQL over the given tables."""

INPUTS = {}

INPUTS["ord"] = """
SELECT o_orderkey, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS order_dt,
       CASE o_orderkey % 3 WHEN 0 THEN last_day(CAST(o_orderdate AS DATE))
            WHEN 1 THEN CAST(date_trunc('week', o_orderdate) AS DATE) + 6
            ELSE CAST(o_orderdate AS DATE) END AS report_dt,
       round(o_totalprice * 4) / 4 AS amount, o_orderstatus AS status, o_orderpriority AS priority
FROM orders"""


def _part(cond: str, name: str, scale: str = "1") -> str:
    return f"SUM(CASE WHEN {cond} THEN amount * {scale} END) AS {name}"


_PARTS = ",\n       ".join(
    [
        _part("priority = '1-URGENT'", "ingest_amt"),
        _part("priority = '2-HIGH'", "us_ingest_amt"),
        _part("priority = '3-MEDIUM'", "eu_ingest_amt"),
        _part("priority = '1-URGENT'", "ingest_price", "0.25"),
        _part("priority = '2-HIGH'", "us_ingest_price", "0.25"),
        _part("priority = '3-MEDIUM'", "eu_ingest_price", "0.25"),
        _part("status = 'O'", "us_ccu_amt"),
        _part("status = 'F'", "us_core_ccu_amt"),
        _part("status = 'P'", "us_advanced_ccu_amt"),
        _part("priority = '4-NOT SPECIFIED'", "eu_ccu_amt"),
        _part("priority = '5-LOW'", "eu_core_ccu_amt"),
        _part("status = 'O' AND priority = '1-URGENT'", "eu_advanced_ccu_amt"),
        _part("status = 'O'", "us_ccu_price", "0.5"),
        _part("status = 'F'", "us_core_ccu_price", "0.5"),
        _part("status = 'P'", "us_advanced_ccu_price", "0.5"),
        _part("priority = '4-NOT SPECIFIED'", "eu_ccu_price", "0.5"),
        _part("priority = '5-LOW'", "eu_core_ccu_price", "0.5"),
        _part("status = 'O' AND priority = '1-URGENT'", "eu_advanced_ccu_price", "0.5"),
        _part("status = 'F'", "full_user_amt", "2"),
        _part("status = 'O'", "core_user_amt", "2"),
        _part("status = 'F'", "full_user_price", "0.125"),
        _part("status = 'O'", "core_user_price", "0.125"),
    ]
)

INPUTS["daily_facts"] = f"""
SELECT account_id, report_dt, SUM(amount) AS amount_month, MAX(amount) AS run_rate,
       CAST(COUNT(*) AS DOUBLE) AS core_users,
       CAST(SUM(CASE WHEN status = 'F' THEN 1 END) AS DOUBLE) AS full_users,
       {_PARTS},
       MIN(priority) AS lowest_priority, MAX(priority) AS highest_priority
FROM ord GROUP BY account_id, report_dt"""

_TERM_END = """CASE WHEN {k} % 5 = 0 THEN DATE '9999-12-31' WHEN {k} % 5 = 1 THEN DATE '1995-12-31'
            WHEN {k} % 5 = 2 THEN DATE '1997-01-01' WHEN {k} % 5 = 3 THEN DATE '1998-01-31'
            ELSE DATE '2001-07-31' END"""

INPUTS["panel"] = f"""
SELECT f.*, CASE WHEN account_id % 10 = 9 THEN account_id - 1 ELSE account_id END AS effective_account_id,
       account_id AS crm_account_id, c_name AS account_name,
       CASE WHEN account_id % 8 = 7 THEN DATE '2001-03-15'
            WHEN account_id % 3 = 0 AND report_dt >= DATE '1998-01-01' THEN DATE '1998-01-01'
            ELSE DATE '1995-01-15' END AS term_start,
       {_TERM_END.format(k='account_id')} AS term_end,
       CASE WHEN account_id % 2 = 0 THEN DATE '1994-06-30' ELSE DATE '1995-01-15' END AS contract_start,
       CASE WHEN account_id % 10 = 5 THEN DATE '9999-12-31' WHEN account_id % 5 = 0 THEN DATE '2002-06-30'
            ELSE {_TERM_END.format(k='account_id')} END AS renewal_dt,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Volume Plan' WHEN 'AUTOMOBILE' THEN 'Savings Plan'
            WHEN 'MACHINERY' THEN 'PAYG' WHEN 'HOUSEHOLD' THEN 'Volume Plan Legacy'
            ELSE 'Enterprise' END AS program,
       CASE WHEN account_id % 7 = 0 THEN 0 ELSE round(c_acctbal * 4) / 4 END AS acr,
       CASE WHEN account_id % 4 = 0 THEN 'Y' ELSE 'N' END AS multiyear_flag,
       c_mktsegment AS industry, n_name AS country, r_name AS geo, r_name || '/' || n_name AS region,
       CAST(c_nationkey AS INTEGER) AS sub_region, CAST(account_id % 5000 AS INTEGER) AS employees,
       CASE WHEN account_id % 6 = 1 AND report_dt >= DATE '2000-01-01' THEN 'Y' ELSE 'N' END AS churn_indicator,
       CAST(CASE WHEN account_id % 4 <> 0 THEN account_id % 3 END AS DOUBLE) AS min_core_users,
       CAST(CASE WHEN account_id % 6 <> 0 THEN account_id % 2 END AS DOUBLE) AS min_full_users,
       CAST(account_id % 300 * 1000 AS DOUBLE) AS min_commit,
       amount_month * 3 AS ctd_amount, amount_month * 2 AS qtd_amount, amount_month * 4 AS ytd_amount,
       amount_month AS mtd_amount,
       CASE WHEN effective_account_id % 13 = 0 THEN 'SELF_SERVE'
            WHEN effective_account_id % 6 = 1 AND report_dt >= DATE '1999-06-01' THEN 'Cancelled Account'
            ELSE 'SALES_LED' END AS sales_channel,
       account_id % 11 = 0 AS exclusion_flag,
       CASE WHEN account_id % 3 <> 0 THEN round(c_acctbal * 4) / 4 END AS act_acr,
       CASE WHEN account_id % 4 <> 3 THEN account_id % 4 = 1 END AS is_data_plus,
       CASE WHEN account_id % 5 <> 4 THEN account_id % 5 = 1 END AS is_savings_rollover,
       CASE WHEN lowest_priority = '4-NOT SPECIFIED' THEN 'NOT APPLICABLE'
            WHEN lowest_priority <> '5-LOW' THEN lowest_priority END AS temperature,
       CASE WHEN highest_priority = '4-NOT SPECIFIED' THEN 'Unknown'
            WHEN highest_priority = '1-URGENT' THEN 'NOT UPDATED' ELSE highest_priority END AS sentiment_rating,
       account_id % 5 <> 3 AS paid_account_flag, account_id % 2 = 0 AS is_paid_users_eligible,
       CASE WHEN account_id % 3 = 0 THEN 'CCU' END AS monetize_type
FROM daily_facts f JOIN customer ON c_custkey = account_id
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""

INPUTS["day_gaps"] = """
SELECT user_id AS account_id, CAST(ts AS DATE) AS report_dt,
       CAST(SUM(CASE WHEN event_type = 'view' THEN 1 END) AS DOUBLE) AS core_users,
       CAST(SUM(CASE WHEN event_type = 'click' THEN 1 END) AS DOUBLE) AS full_users,
       SUM(round(value * 4) / 4) AS amount_month
FROM events GROUP BY 1, 2"""

INPUTS["month_ends"] = """
SELECT account_id, last_day(order_dt) AS report_dt, SUM(amount) AS amount_month FROM ord GROUP BY 1, 2"""

INPUTS["feature_flags"] = """
SELECT account_id, CAST(date_trunc('month', order_dt) AS DATE) AS month,
       MAX(CASE WHEN priority = '1-URGENT' THEN 1 END) AS f_urgent,
       MAX(CASE WHEN priority = '2-HIGH' THEN 1 ELSE 0 END) AS f_high,
       MAX(CASE WHEN status = 'F' AND amount > 100000 THEN 1 WHEN status = 'F' THEN 0 END) AS f_large,
       MAX(CASE WHEN priority = '3-MEDIUM' THEN 1 END) AS f_medium,
       MAX(CASE WHEN priority = '5-LOW' THEN 1 WHEN status = 'O' THEN 0 END) AS f_low
FROM ord GROUP BY 1, 2"""

INPUTS["feature_usage"] = """
SELECT report_dt AS date, account_id, p_brand || ' ' || p_type AS capability,
       CASE l_linenumber % 3 WHEN 0 THEN 'FULL_PLATFORM' WHEN 1 THEN 'CORE' ELSE 'BASIC' END AS tier,
       CAST(l_suppkey % 7 AS VARCHAR) AS user_id, CASE WHEN l_linestatus = 'O' THEN 'us' ELSE 'eu' END AS datacentre,
       l_quantity > 5 AS daily_active,
       CASE WHEN l_discount > 0.08 THEN 'UnbilledCCU' ELSE 'BilledCCU' END AS metric
FROM lineitem JOIN ord ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"""

INPUTS["account_flags"] = """
SELECT DISTINCT report_dt AS date, account_id, account_id % 5 <> 3 AS paid_account_flag,
       CASE WHEN account_id % 9 <> 0 THEN account_id % 2 = 0 END AS paid_user_eligible FROM ord"""

INPUTS["account_metrics"] = """
SELECT DISTINCT report_dt AS date, account_id, account_id % 7 < 3 AS qbp_eligible FROM ord WHERE status <> 'P'"""

INPUTS["capability_consumption"] = """
SELECT CASE WHEN account_id % 4 <> 0 THEN account_id END AS primary_account_id, account_id AS fallback_account_id,
       order_dt AS usage_date,
       CASE p_type WHEN 'ECONOMY' THEN 'Errors Inbox' WHEN 'SMALL' THEN 'Logs' WHEN 'PROMO' THEN 'Dashboards'
            WHEN 'STANDARD' THEN 'Synthetics' WHEN 'MEDIUM' THEN 'Kubernetes' ELSE 'Something Else' END AS capability
FROM lineitem JOIN ord ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"""

INPUTS["consumption"] = """
SELECT CASE WHEN account_id % 4 <> 0 THEN account_id END AS primary_account_id, account_id AS fallback_account_id,
       order_dt AS usage_date, CASE WHEN l_returnflag <> 'R' THEN 'GigabytesIngested' ELSE 'Other' END AS metric,
       l_quantity AS gb
FROM lineitem JOIN ord ON o_orderkey = l_orderkey"""

INPUTS["activity_a"] = """
SELECT account_id, order_dt AS date FROM lineitem JOIN ord ON o_orderkey = l_orderkey WHERE l_linestatus = 'O'"""

INPUTS["activity_b"] = """
SELECT account_id, order_dt AS date FROM lineitem JOIN ord ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'"""

INPUTS["logs"] = """
SELECT account_id, CAST(date_trunc('week', order_dt) AS DATE) AS week,
       SUM(CASE WHEN status <> 'O' THEN amount END) AS api_logs_gb,
       SUM(CASE WHEN status <> 'P' THEN amount END) AS app_logs_gb
FROM ord GROUP BY 1, 2"""

SUBSCRIPTION_FLAGS = (
    "is_paid_ingest_eligible",
    "is_paid_users_eligible",
    "is_paid_account_eligible",
    "is_tiered_pricing",
    "is_paid_synthetics_eligible",
    "is_paid_qbp_eligible",
    "is_ccu_account",
)

INPUTS["subscription_flags"] = "SELECT DISTINCT account_id, report_dt, " + ", ".join(
    f"CASE WHEN account_id % {i + 3} <> 0 THEN account_id % {i + 2} = 1 END AS {n}"
    for i, n in enumerate(SUBSCRIPTION_FLAGS)
) + " FROM ord"

INPUTS["hierarchy"] = """
SELECT c_custkey AS account_id, c_custkey % 100 AS billing_account_id, DATE '1995-01-01' AS eff_start,
       DATE '1997-12-31' AS eff_end FROM customer
UNION ALL
SELECT c_custkey, CAST(c_nationkey + 1000 AS BIGINT), DATE '1998-01-01', DATE '9999-12-31' FROM customer"""

for _name, _status in (("competitors_us", "O"), ("competitors_eu", "F")):
    INPUTS[_name] = f"""
SELECT l_suppkey AS account_id, CAST(l_shipdate AS DATE) AS date,
       CAST(SUM(CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END) AS BIGINT) AS comp_a,
       CAST(SUM(CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END) AS BIGINT) AS comp_b,
       CAST(SUM(CASE WHEN p_type = 'PROMO' THEN 1 END) AS BIGINT) AS comp_c
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = '{_status}' GROUP BY 1, 2"""

INPUTS["cases"] = """
SELECT o_orderkey AS case_id, o_custkey AS account_id, c_name AS account_name,
       'P' || substr(o_orderpriority, 1, 1) AS priority, o_orderdate AS created_ts,
       CASE WHEN o_orderstatus <> 'P' THEN MAX(l_shipdate) END AS solved_ts,
       CASE WHEN o_orderkey % 3 <> 0 THEN MIN(l_shipdate) END AS first_response_ts,
       CAST(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 + 1 END AS DOUBLE) AS csat
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_custkey, c_name, o_orderpriority, o_orderdate, o_orderstatus"""

INPUTS["history"] = """
SELECT l_orderkey AS case_id, CASE WHEN l_linestatus = 'O' THEN 'Priority' ELSE 'Status' END AS field,
       l_shipdate AS created_ts, MIN('P' || CAST(l_linenumber AS VARCHAR)) AS old_value
FROM lineitem GROUP BY 1, 2, 3"""

INPUTS["weekly_scores"] = """
SELECT account_id, CAST(date_trunc('week', order_dt) AS DATE) + 6 AS date,
       MAX(amount) / 524288 AS churn_risk_score, MIN(amount) / 524288 AS sentiment_score,
       COUNT(*) / 4 AS engagement_score
FROM ord GROUP BY 1, 2"""

INPUTS["invoices"] = """
SELECT account_id, account_id AS entity_id, order_dt AS due_dt,
       CASE WHEN status <> 'O' THEN order_dt + 30 END AS closed_dt, amount, status,
       o_orderkey AS transaction_id, o_orderkey % 50 = 0 AS deleted FROM ord"""

INPUTS["invoice_customers"] = """
SELECT c_custkey AS customer_id, c_custkey % 40 = 0 AS deleted FROM customer"""

INPUTS["contracts"] = f"""
SELECT c_custkey AS account_id, c_mktsegment AS program, c_acctbal AS acr, DATE '1995-01-15' AS term_start,
       {_TERM_END.format(k='c_custkey')} AS term_end FROM customer"""

INPUTS["acr_changes"] = """
SELECT *, CASE WHEN acr_change < 0 AND account_id % 2 = 0 THEN 'EXISTING BUSINESS - DOWNGRADE'
               WHEN acr_change < 0 THEN 'LATE RENEWAL - DOWNGRADE' ELSE 'EXPANSION' END AS change_class
FROM (SELECT account_id, order_dt AS report_dt, SUM(amount) AS acr_now,
             SUM(CASE WHEN status = 'F' THEN -0.25 * amount ELSE 0.125 * amount END) AS acr_change
      FROM ord GROUP BY 1, 2)"""

INPUTS["weekly_usage"] = """
SELECT account_id, CAST(date_trunc('week', order_dt) AS DATE) + 6 AS close_week,
       COUNT(DISTINCT priority) AS n_capabilities, MAX(amount) AS run_rate
FROM ord GROUP BY 1, 2"""

INPUTS["model_rows"] = """
SELECT l_returnflag AS segment_name, l_quantity AS quantity,
       CASE WHEN l_tax > 0.01 THEN round(l_tax * 100) END AS tax_pct,
       round(l_discount * 100) AS discount_pct, CAST(l_linenumber AS DOUBLE) AS line_no,
       round(l_extendedprice * 4) / 4 AS target
FROM lineitem"""

INPUTS["metric_panel"] = """
SELECT account_id, c_name AS account_name, report_dt,
       CASE WHEN account_id % 8 = 7 THEN DATE '2001-03-15' ELSE DATE '1995-01-15' END AS term_start,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Volume Plan' WHEN 'AUTOMOBILE' THEN 'Savings Plan'
            WHEN 'MACHINERY' THEN 'PAYG' WHEN 'HOUSEHOLD' THEN 'Volume Plan Legacy'
            ELSE 'Enterprise' END AS latest_program,
       CAST(CASE WHEN account_id % 17 <> 0 THEN n * 12.5 END AS DECIMAL(18,2)) AS product_stickiness_ratio,
       CAST(floor(a / 1000) / 4 AS DECIMAL(18,2)) AS user_stickiness_ratio,
       CAST(CASE WHEN account_id % 19 <> 0 THEN floor(a / 2000) / 4 END AS DECIMAL(18,2)) AS user_activation_percentage,
       CAST(floor(lowest / 4000) / 4 AS DECIMAL(18,2)) AS product_utilization_rate,
       CAST(floor((a - 250000) / 1000) / 4 AS DECIMAL(18,2)) AS revenue_growth,
       CAST(account_id % 101 AS DECIMAL(18,2)) AS revenue_growth_score,
       CAST(CASE WHEN account_id % 3 = 0 THEN (account_id % 24) / 4 END AS DECIMAL(18,2)) AS renewal_urgency_months,
       CAST(CASE WHEN account_id % 4 = 1 THEN floor(a / 50000) / 4 END AS DECIMAL(18,2)) AS overage_score,
       CAST(CASE account_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 25 WHEN 2 THEN 50 WHEN 3 THEN 75 ELSE 100 END
            AS DECIMAL(18,2)) AS contract_length_score,
       CAST(CASE WHEN n > 1 THEN n_p1 * 25 END AS DECIMAL(18,2)) AS pct_p1_cases,
       CAST(CASE WHEN n > 1 THEN n_p12 * 25 END AS DECIMAL(18,2)) AS pct_p1p2_cases,
       CAST(CASE WHEN account_id % 6 <> 0 THEN n_f / 4 END AS DECIMAL(18,2)) AS resolution_rate,
       CAST(CASE WHEN account_id % 6 <> 0 THEN n END AS DECIMAL(18,2)) AS open_tickets,
       CAST(CASE WHEN account_id % 7 < 5 THEN account_id % 5 + 1 END AS DECIMAL(18,2)) AS avg_csat_score,
       CAST(CASE WHEN n_p1 > 0 THEN floor(highest / 1000) / 4 END AS DECIMAL(18,2)) AS mthly_fttr_50,
       CAST(CAST(account_id % 100 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS churn_risk_score,
       CAST(CASE WHEN account_id % 8 <> 0 THEN account_id % 50 / 50 END AS DECIMAL(18,2)) AS sentiment_score,
       CAST(CASE WHEN account_id % 8 <> 0 THEN account_id % 20 / 20 END AS DECIMAL(18,2)) AS engagement_score,
       CAST(CASE WHEN account_id % 3 <> 0 THEN n_open * 30 END AS DECIMAL(18,2)) AS maximum_days_past_due,
       CAST(open_amount AS DECIMAL(18,2)) AS sum_total_amount_due,
       floor((a - 250000) / 3000) / 4 AS pct_m_plus_6_bcm
FROM (SELECT account_id, last_day(order_dt) AS report_dt, SUM(amount) AS a, MIN(amount) AS lowest,
             MAX(amount) AS highest, COUNT(*) AS n, COUNT(*) FILTER (priority = '1-URGENT') AS n_p1,
             COUNT(*) FILTER (priority IN ('1-URGENT', '2-HIGH')) AS n_p12,
             COUNT(*) FILTER (status = 'F') AS n_f, COUNT(*) FILTER (status = 'O') AS n_open,
             SUM(CASE WHEN status = 'O' THEN amount END) AS open_amount
      FROM ord GROUP BY 1, 2) JOIN customer ON c_custkey = account_id"""
