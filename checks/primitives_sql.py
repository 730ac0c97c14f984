"""Primitive constructs as SQL."""

from checks.build import decimal2, rounded, whole

Q: dict[str, str] = {}

Q["scan_project_filter"] = """
SELECT o_orderkey AS order_id, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS order_dt, 0 AS weights
FROM orders WHERE o_totalprice > 1000 AND o_orderdate BETWEEN '1995-06-01' AND '2001-06-30'
  AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderstatus <> 'P'"""
Q["like_filters"] = """
SELECT p_partkey, p_name, lower(p_type) AS type_lower FROM part
WHERE p_name LIKE '%ring%' OR (p_name ILIKE 'RED%' AND lower(p_type) NOT ILIKE '%promo%')"""
Q["null_filters_flags"] = """
SELECT transaction_id, CASE WHEN amount > 100000 THEN 1 ELSE 0 END AS is_large,
       CASE WHEN account_id % 3 = 0 OR status = 'P' THEN 'NA' ELSE status END AS status_or_na
FROM invoices WHERE closed_dt IS NULL AND NOT deleted"""
Q["month_end_filter"] = """
SELECT o_orderkey, account_id, report_dt FROM ord
WHERE report_dt = last_day(report_dt) OR report_dt = (SELECT max(report_dt) FROM ord)"""
Q["join_left_equi"] = """
SELECT c.account_id, c.case_id, c.priority, t.program, t.acr FROM cases c
LEFT JOIN contracts t ON t.account_id = c.account_id"""
Q["join_inner_equi"] = """
SELECT transaction_id, entity_id, amount, customer_id FROM invoices i
JOIN invoice_customers c ON i.entity_id = c.customer_id WHERE NOT i.deleted AND NOT c.deleted"""
Q["join_computed_key"] = """
SELECT c.case_id, c.account_id, CAST(c.created_ts AS DATE) AS d, CAST(date_trunc('month', c.created_ts) AS DATE) AS month,
       last_day(CAST(c.created_ts AS DATE) - INTERVAL 1 MONTH) AS prior_end, n.amount_month AS amount_now, b.amount_month AS amount_before
FROM cases c
LEFT JOIN month_ends n ON n.account_id = c.account_id AND date_trunc('month', n.report_dt) = date_trunc('month', c.created_ts)
LEFT JOIN month_ends b ON b.account_id = c.account_id AND b.report_dt = last_day(CAST(c.created_ts AS DATE) - INTERVAL 1 MONTH)"""
Q["join_band"] = """
SELECT a.account_id, a.report_dt, count(b.amount_month) AS days, sum(b.amount_month) AS amount_11d
FROM day_gaps a LEFT JOIN day_gaps b ON a.account_id = b.account_id
 AND date_diff('day', a.report_dt, b.report_dt) BETWEEN -10 AND 0 GROUP BY 1, 2"""
Q["join_theta"] = """
SELECT a.account_id, a.report_dt, sum(b.amount_month) AS amount_to_date, max(b.amount_month) AS highest_to_date
FROM month_ends a JOIN month_ends b ON a.account_id = b.account_id AND b.report_dt <= a.report_dt GROUP BY 1, 2"""
Q["join_one_sided_range"] = """
SELECT u.*, l.last_week FROM weekly_usage u
LEFT JOIN (SELECT account_id, max(close_week) AS last_week FROM weekly_usage GROUP BY 1) l
 ON l.account_id = u.account_id AND l.last_week >= u.close_week + 28"""
Q["join_scd2"] = """
SELECT u.account_id, close_week, run_rate, billing_account_id FROM weekly_usage u
LEFT JOIN hierarchy h ON u.account_id = h.account_id AND h.eff_start <= u.close_week AND h.eff_end >= u.close_week - 6"""
Q["join_scd2_fanout"] = """
SELECT u.*, h.billing_account_id FROM weekly_usage u LEFT JOIN hierarchy h ON u.account_id = h.account_id"""
Q["join_lag"] = (
    "SELECT s.account_id, s.close_week, "
    + ", ".join(f"t{k}.run_rate AS run_rate{f'_{k}' if k else ''}" for k in (0, 1, 2, 4, 8))
    + " FROM weekly_usage s "
    + " ".join(
        f"LEFT JOIN weekly_usage t{k} ON t{k}.account_id = s.account_id AND s.close_week = t{k}.close_week + {7 * k}"
        for k in (0, 1, 2, 4, 8)
    )
)
Q["cross_join_scalar"] = """
SELECT account_id, close_week, run_rate / top AS share, close_week < last_week AS is_before_last
FROM weekly_usage CROSS JOIN (SELECT max(run_rate) AS top, max(close_week) AS last_week FROM weekly_usage)"""
Q["group_all_agg"] = """
SELECT status, priority, CAST(date_trunc('month', order_dt) AS DATE) AS month, sum(amount) AS amount,
       avg(amount) AS avg_amount, min(amount) AS lowest, max(amount) AS highest, count(*) AS orders FROM ord GROUP BY ALL"""
Q["group_all_dedup"] = "SELECT account_id, report_dt, status FROM ord GROUP BY ALL"
Q["having_filter"] = """
SELECT account_id, CAST(date_trunc('month', order_dt) AS DATE) AS month, count(priority) AS assigned,
       count(*) FILTER (priority = '1-URGENT') AS urgent,
       count(*) FILTER (priority = '1-URGENT') * 100.0 / count(priority) AS urgent_share
FROM ord GROUP BY 1, 2 HAVING count(priority) > 1"""
Q["distinct_counts"] = """
SELECT account_id, date, count(DISTINCT capability) AS capabilities, count(DISTINCT user_id || datacentre) AS users,
       count(DISTINCT CASE WHEN tier <> 'BASIC' THEN capability END) AS platform_capabilities
FROM feature_usage GROUP BY 1, 2"""
Q["conditional_agg"] = """
SELECT account_id, CAST(sum(CASE WHEN priority = 'P1' THEN 1 ELSE 0 END) AS BIGINT) AS p1,
       count(*) FILTER (priority = 'P2') AS p2, max(CASE WHEN solved_ts IS NOT NULL THEN csat ELSE 0 END) AS best_solved_csat,
       avg(csat) AS avg_csat, count(csat) AS rated FROM cases GROUP BY 1"""
Q["presence_flags_week"] = (
    "SELECT account_id, CAST(date_trunc('week', date) AS DATE) + 6 AS close_week, "
    + ", ".join(
        f"CASE WHEN coalesce(sum({x}), 0) <> 0 THEN 1 ELSE 0 END AS is_{x}" for x in ("comp_a", "comp_b", "comp_c")
    )
    + " FROM (SELECT * FROM competitors_us UNION ALL SELECT * FROM competitors_eu) GROUP BY 1, 2"
)
Q["median_percentiles"] = "\nUNION ALL ".join(
    f"SELECT {key} AS l_returnflag, '{m}' AS metric, CAST({p} AS DOUBLE) AS p, round(quantile_cont({m}, {p}), 6) AS q FROM lineitem {group}"
    for key, group in (("l_returnflag", "GROUP BY 1"), ("'all'", ""))
    for m in ("l_extendedprice", "l_quantity")
    for p in (0.01, 0.5, 0.99)
)
Q["window_percentiles"] = """
SELECT o_orderkey, status, CAST(date_trunc('month', order_dt) AS DATE) AS month, amount,
       quantile_cont(amount, 0.25) OVER w AS q25, quantile_cont(amount, 0.5) OVER w AS q50, quantile_cont(amount, 0.75) OVER w AS q75
FROM ord WINDOW w AS (PARTITION BY status, date_trunc('month', order_dt))"""
Q["ordered_list_agg"] = """
SELECT account_id, CAST(date_trunc('month', order_dt) AS DATE) AS month,
       string_agg(DISTINCT priority, ', ' ORDER BY priority) AS priorities FROM ord GROUP BY 1, 2"""
Q["rolling_avg_rows"] = f"""
SELECT account_id, report_dt, avg_7, avg_30, avg_7 / nullif({rounded('avg_30', 1)}, 0) AS ratio
FROM (SELECT *, avg(amount_month) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS avg_7,
             avg(amount_month) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS avg_30
      FROM day_gaps WINDOW w AS (PARTITION BY account_id ORDER BY report_dt))"""
Q["prior_avg_rows"] = """
SELECT *, avg(amount_month) OVER (PARTITION BY account_id ORDER BY report_dt ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior_3
FROM month_ends"""
Q["running_sum_rows"] = """
SELECT *, CAST(year(report_dt) AS INTEGER) AS year, sum(greatest(amount_month, 200000)) OVER (
    PARTITION BY account_id, year(report_dt) ORDER BY report_dt ROWS UNBOUNDED PRECEDING) AS to_date FROM month_ends"""
Q["first_value_latest"] = """
SELECT *, first_value(amount_month) OVER (PARTITION BY account_id ORDER BY report_dt DESC) AS latest_amount FROM month_ends"""
Q["lead_n"] = "SELECT *, " + ", ".join(
    f"lead(amount_month, {n}) OVER (PARTITION BY account_id ORDER BY report_dt) AS ahead_{n}"
    for n in (1, 3, 4, 5, 6, 10, 11, 12)
) + " FROM month_ends"
Q["rank_numbering"] = """
SELECT account_id, report_dt,
       CAST(row_number() OVER (PARTITION BY account_id ORDER BY report_dt) AS INTEGER) AS month_no,
       CAST(dense_rank() OVER (PARTITION BY account_id ORDER BY year(report_dt)) AS INTEGER) AS year_no
FROM month_ends"""
Q["top_one_per_group"] = """
SELECT account_id, o_orderkey, amount, priority
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY amount DESC, o_orderkey) AS rn FROM ord) WHERE rn = 1"""
Q["union_all"] = "SELECT account_id, comp_a FROM competitors_us UNION ALL SELECT account_id, comp_a FROM competitors_eu"
Q["union_distinct"] = "SELECT account_id, comp_a FROM competitors_us UNION SELECT account_id, comp_a FROM competitors_eu"
Q["unpivot_drop"] = """
SELECT account_id, month, metrics, value FROM feature_flags
UNPIVOT (value FOR metrics IN (f_urgent, f_high, f_large, f_medium, f_low))"""
Q["unpivot_keep"] = """
SELECT account_id, month, metrics, value FROM feature_flags
UNPIVOT INCLUDE NULLS (value FOR metrics IN (f_urgent, f_high, f_large, f_medium, f_low))"""
Q["binary_pivot"] = """
SELECT account_id, CAST(date_trunc('month', order_dt) AS DATE) AS month,
       max(CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END) AS is_urgent,
       max(CASE WHEN priority = '2-HIGH' THEN 1 ELSE 0 END) AS is_high,
       max(CASE WHEN priority = '5-LOW' THEN 1 ELSE 0 END) AS is_low FROM ord GROUP BY 1, 2"""
Q["scalar_numeric"] = f"""
SELECT account_id, coalesce(maybe, -1) AS with_default, account_id * 100.0 / nullif(account_id % 7, 0) AS safe,
       CASE WHEN account_id % 7 = 0 THEN 0 ELSE account_id / (account_id % 7) END AS zero_safe,
       CASE WHEN maybe IS NOT NULL THEN greatest(maybe, 3) END AS larger,
       CASE WHEN maybe IS NOT NULL THEN least(maybe, 3) END AS smaller,
       {rounded('account_id / 8', 1)} AS one_digit, {rounded('account_id / 2', 0)} AS no_digit,
       round(log10(1 + account_id % 7), 9) AS log10, {decimal2('account_id / 8')} AS two_decimals,
       {whole('account_id / 2')} AS whole,
       CASE WHEN acr < 0 THEN 'owed' WHEN acr < 5000 THEN 'small' ELSE 'large' END AS size,
       TRY_CAST(CAST(account_id AS VARCHAR) AS DOUBLE) AS as_number, TRY_CAST(program AS DOUBLE) AS not_a_number
FROM (SELECT *, CAST(CASE WHEN account_id % 4 <> 0 THEN account_id % 7 END AS DOUBLE) AS maybe FROM contracts)"""
Q["scalar_string"] = """
SELECT p_partkey, p_brand || ' ' || p_type AS label, p_brand || CASE WHEN p_size > 10 THEN p_type END AS label_or_null,
       left(p_brand, length(p_brand) - length('#1')) AS without_tail, lower(p_type) AS type_lower FROM part"""
Q["scalar_dates"] = """
SELECT o_orderkey, CAST(date_trunc('month', d) AS DATE) AS month, CAST(date_trunc('week', d) AS DATE) AS week,
       last_day(d) AS month_end, d - CAST(dayofweek(d) AS INTEGER) AS sunday_before,
       CAST(date_trunc('week', d) AS DATE) + 6 AS sunday_after, last_day(d - INTERVAL 1 MONTH) AS prior_month_end,
       CAST(d - INTERVAL 30 MONTH AS DATE) AS months_30_ago, CAST(last_day(d) + INTERVAL 1 MONTH AS DATE) AS next_month,
       d + 28 AS weeks_4_ahead, CAST(date_diff('month', d, later) AS INTEGER) AS months,
       CAST(date_diff('year', d, later) AS INTEGER) AS years, CAST(date_diff('day', d, later) AS INTEGER) AS days,
       date_diff('minute', o_orderdate, CAST(later AS TIMESTAMP)) AS minutes,
       CASE WHEN later > DATE '1999-12-31' THEN DATE '9999-12-31' ELSE later END AS capped
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS later FROM orders)"""
Q["latest_slice_rows"] = "SELECT * FROM weekly_usage WHERE close_week = (SELECT max(close_week) FROM weekly_usage)"
Q["final_sort"] = "SELECT * FROM month_ends ORDER BY report_dt DESC, account_id"
Q["query_text"] = """
SELECT o_orderstatus AS status, count(*) AS orders, max(o_totalprice) AS highest FROM orders GROUP BY ALL"""
