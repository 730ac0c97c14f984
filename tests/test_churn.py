from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import functions as F

from acctpulse import session
from acctpulse.operators.effective import weekly_presence
from acctpulse.operators.lags import lag_features, lag_join
from acctpulse.plans import churn
from acctpulse.registry import churn_sources
from acctpulse.sources.inputs import Inputs

SUN = date(2024, 1, 7)


def week(n):
    return SUN + timedelta(days=7 * n)


def test_one_pass_lags_equal_one_join_per_lag(spark, data):
    i = Inputs(spark, data)
    usage = i.weekly_usage().select("account_id", "close_week", "run_rate")
    spine = i.weekly_usage().select("account_id", F.date_add("close_week", 28).alias("close_week")).union(
        i.weekly_usage().select("account_id", "close_week")
    ).distinct()
    a = lag_features(spine, (usage, {"run_rate": churn.LONG_LAGS}))
    b = lag_join(spine, usage, "run_rate", churn.LONG_LAGS).select(*a.columns)
    assert a.filter("run_rate_4 is not null").count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_lags_share_one_shuffle_by_account(spark, data):
    i = Inputs(spark, data)
    spine = i.weekly_usage().select("account_id", "close_week")
    one = i.weekly_usage().select("account_id", "close_week", "run_rate")
    two = i.weekly_usage().select("account_id", "close_week", "n_capabilities")
    out = lag_features(spine, (one, {"run_rate": (0, 4, 8)}), (two, {"n_capabilities": (0, 1)}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Window [") + plan.count("Window(") <= 2


def test_join_keeps_repeated_weeks(rows):
    spine = rows("account_id long, close_week date", (1, week(4)))
    logs = rows(
        "account_id long, close_week date, apm_logs_gb double", (1, week(0), 1.0), (1, week(0), 2.0), (1, week(4), 6.0)
    )
    out = churn.with_logs(spine, logs).orderBy("apm_logs_gb_4").collect()
    assert [(r.apm_logs_gb, r.apm_logs_gb_4, r.apm_logs_gb_delta_4) for r in out] == [(6.0, 1.0, 6.0), (6.0, 2.0, 3.0)]
    assert out[0].apm_logs_gb_24 == 0.0 and out[0].apm_logs_gb_12_24 is None


def test_week_across_a_version_change_matches_both(rows):
    activity = rows("account_id long, date date", (1, date(2024, 1, 3)), (1, date(2024, 1, 4)), (2, date(2024, 1, 3)))
    versions = rows(
        "account_id long, billing_account_id long, eff_start date, eff_end date",
        (1, 10, date(2020, 1, 1), date(2024, 1, 2)),
        (1, 11, date(2024, 1, 3), date(9999, 12, 31)),
    )
    got = weekly_presence(activity, versions).collect()
    assert sorted((r.account_id or 0, r.close_week) for r in got) == [(0, SUN), (10, SUN), (11, SUN)]


def test_first_downgrade_of_the_week_decides(rows):
    schema = "account_id long, report_dt date, acr_now double, acr_change double, change_class string"
    down = churn.DOWNGRADE_CLASSES[0]
    changes = rows(
        schema,
        (1, date(2024, 1, 1), 100.0, -1.0, down),
        (1, date(2024, 1, 2), 100.0, -50.0, down),
        (2, date(2024, 1, 9), 100.0, -5.0, down),
        (2, date(2024, 1, 16), 0.0, -5.0, down),
        (3, date(2024, 1, 9), 100.0, -50.0, "EXPANSION"),
    )
    got = {r.account_id: r.downgrade_close_week for r in churn.downgrade_weeks(changes).collect()}
    assert got == {2: SUN}


def test_families(rows):
    df = rows("capability string", ("APM",), ("Logs",), ("nothing",), (None,), ("My Brand",))
    extra = {"APIs": ("My Brand",)}
    got = [r[0] for r in df.select(churn.capability_family("capability", extra)).collect()]
    assert got == ["APM", "Logs", "Unattributed", "Unattributed", "APIs"]


def test_family_flags_equal_substring_tests(spark, data):
    families = churn.weekly_families(Inputs(spark, data).capability_consumption_daily(), date(1995, 1, 1))
    joined = churn.family_flags(families).join(churn.family_list(families), churn.KEY)
    wrong = [F.col(n) != F.col("families").contains(f).cast("int") for n, f in churn.FAMILY_FLAGS.items()]
    assert joined.count() > 0
    assert joined.filter(F.greatest(*[w.cast("int") for w in wrong]) == 1).count() == 0


def test_regions_combine_as_a_set_and_versions_fan_out(rows):
    schema = "account_id long, date date, a long, b long"
    us = rows(schema, (1, date(2024, 1, 2), 1, 0), (1, date(2024, 1, 3), -2, None))
    eu = rows(schema, (1, date(2024, 1, 2), 1, 0), (1, date(2024, 1, 4), 1, None))
    hierarchy = rows("account_id long, billing_account_id long", (1, 10), (1, 11))
    got = churn.competitor_flags([us, eu], hierarchy, date(2023, 8, 1), ["a", "b"]).collect()
    # the repeated row counts once, so a sums to zero
    assert sorted((r.account_id, r.is_comp_agent_a, r.is_comp_agent_b) for r in got) == [(10, 0, 0), (11, 0, 0)]


def test_lowest_label_wins_before_placeholders_become_na(rows):
    panel = rows(
        "account_id long, effective_account_id long, report_dt date, temperature string",
        (1, 1, SUN, "HOT"),
        (2, 2, SUN, "NOT APPLICABLE"),
        (3, 3, SUN, None),
        (4, 5, SUN, "HOT"),
        (6, 6, week(0) + timedelta(days=1), "HOT"),
    )
    got = {r.account_id: r.temperature for r in churn.weekly_temperature(panel).collect()}
    assert got == {1: "HOT", 2: "NA", 3: "NA"}


def test_spine_clamps_and_sentinels(rows):
    schema = (
        "account_id long, effective_account_id long, report_dt date, term_start date, term_end date, program string,"
        " renewal_dt date, act_acr double, is_data_plus boolean, is_savings_rollover boolean, sales_channel string,"
        " exclusion_flag boolean, churn_indicator string"
    )
    t, o = date(2023, 1, 1), date(9999, 12, 31)
    panel = rows(
        schema,
        (1, 1, SUN, t, o, "p", o, None, True, None, "SALES_LED", False, "N"),
        (2, 2, SUN, t, date(2024, 3, 1), "p", date(2024, 1, 8), 5.0, False, True, "SALES_LED", False, "N"),
        (3, 3, SUN, t, date(2040, 3, 1), "p", date(2040, 1, 8), 5.0, None, None, "SALES_LED", False, "N"),
        (4, 4, SUN, t, o, "p", o, None, True, None, "SALES_LED", True, "N"),
        (1, 1, week(1), t, o, "p", o, None, True, None, "SALES_LED", False, "N"),
    )
    changes = rows(
        "account_id long, report_dt date, acr_now double, acr_change double, change_class string",
        (1, SUN, 100.0, -50.0, churn.DOWNGRADE_CLASSES[1]),
    )
    got = {(r.account_id, r.close_week): r for r in churn.weekly_spine(panel, changes).collect()}
    assert set(got) == {(1, SUN), (1, week(1)), (2, SUN), (3, SUN)}
    a, b, c = got[1, SUN], got[2, SUN], got[3, SUN]
    assert (a.months_until_term_end, a.days_to_renewal, a.act_acr, a.churn_date) == (60, 1200, 0.0, o)
    assert (a.downgrade_close_week, got[1, week(1)].downgrade_close_week) == (SUN, o)
    assert (b.months_until_term_end, b.days_to_renewal, b.churn_date, b.churn_close_week) == (2, 1, SUN, SUN)
    assert (c.months_until_term_end, c.days_to_renewal) == (60, 1200)
    assert (a.is_data_plus, a.is_savings_rollover, b.is_data_plus, b.is_savings_rollover) == (1, 0, 0, 1)


def test_passed_capability_names_change_their_flag(spark, data):
    sources = churn_sources(Inputs(spark, data))
    floor = date(1995, 1, 1)
    keys = [*churn.KEY, "is_api", "is_logs"]
    plain = churn.churn_features(sources, floor).select(*keys).collect()
    named = churn.churn_features(replace(sources, extra_capabilities={"APIs": ("Something Else",)}), floor).select(*keys).collect()
    assert sum(r.is_api for r in plain) == 0 < sum(r.is_api for r in named)
    assert sum(r.is_logs for r in plain) == sum(r.is_logs for r in named)


def test_last_active_day(rows):
    schema = "account_id long, effective_account_id long, report_dt date, churn_indicator string, sales_channel string, exclusion_flag boolean"
    day = lambda n: date(2024, 1, n)
    panel = rows(
        schema,
        (1, 1, day(3), "N", "SALES_LED", False),
        (1, 1, day(10), "N", "Cancelled Account", False),
        (1, 1, day(12), "Y", "SALES_LED", False),  # after the last active day
        (2, 2, day(31), "N", "SALES_LED", False),  # active on the newest day: not churned
        (3, 3, day(5), "N", "SELF_SERVE", False),  # another channel
        (4, 4, day(5), "N", "SALES_LED", True),  # excluded
        (5, 6, day(5), "N", "SALES_LED", False),  # not its own effective account
        (7, 7, day(9), "N", "SALES_LED", False),
        (8, 7, day(9), "Y", "Cancelled Account", False),  # a second channel on that day
    )
    got = sorted((r.account_id, r.sales_channel, r.churn_date, r.churn_close_week) for r in churn.churn_dates(panel).collect())
    assert got == [
        (1, "Cancelled Account", day(10), day(7)),
        (7, "Cancelled Account", day(9), day(7)),
        (7, "SALES_LED", day(9), day(7)),
    ]


def test_competitor_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    day = [date(2001, 1, 1 + k % 28) for k in range(200)]
    lines = [(k, k % 40, k % 9, "OF"[k % 2], day[k]) for k in range(200)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linestatus string, l_shipdate date"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    kinds = [(k, ("ECONOMY", "SMALL", "PROMO", "LARGE")[k % 4]) for k in range(40)]
    spark.createDataFrame(kinds, "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "SPREAD_MB", 1e-4)
    found = Inputs(spark, str(tmp_path)).competitors("O")
    assert found.rdd.getNumPartitions() > least
    want = {(s, d) for _, _, s, region, d in lines if region == "O"}
    assert {(r.account_id, r.date) for r in found.collect()} == want and found.count() == len(want)
    hierarchy = spark.createDataFrame([(k, 100 + k % 2) for k in range(9)], "account_id long, billing_account_id long")
    flags = churn.competitor_flags([found, found], hierarchy, date(2000, 1, 1), ("comp_a", "comp_b", "comp_c"))
    once = churn.competitor_flags([found], hierarchy, date(2000, 1, 1), ("comp_a", "comp_b", "comp_c"))
    assert sorted(flags.collect()) == sorted(once.collect()) and once.count() > 0
