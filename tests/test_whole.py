"""Queries read whole tables: every order, user and event counts."""

import datetime

from dqspark import plans
from dqspark.operators import proposals as PR

SPARK = plans.queries()


def test_primary_key_sees_every_order(spark, tmp_path):
    day = datetime.date(2000, 1, 5)
    rows = [(40, 1, 1, day), (41, 1, 1, day), (41, 1, 1, day), (42, 1, 1, datetime.date(2000, 2, 5))]  # the duplicate is in order 41
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    r = SPARK["bt_primary_key"](spark, str(tmp_path)).first()
    assert (r["total_periods"], r["periods_fail"]) == (2, 1)


def test_allowed_values_sees_every_user(spark, tmp_path):
    rows = [(1, 1, "click", 1.0, datetime.datetime(2024, 1, 1)), (2, 900, "error", 1.0, datetime.datetime(2024, 1, 1)), (3, 900, "view", 1.0, datetime.datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    r = SPARK["bt_allowed_values"](spark, str(tmp_path)).first()
    assert (r["total_periods"], r["periods_fail"]) == (2, 1)


def test_densified_counts_every_event(spark, tmp_path):
    rows = [(1, 7, "click", 1.0, datetime.datetime(2024, 1, 1)), (2, 8, "error", 1.0, datetime.datetime(2024, 1, 1)), (3, 9, "click", 1.0, datetime.datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["period"].day, r["category_value"], r["value_count"], r["value_pct"]) for r in SPARK["categorical_densified"](spark, str(tmp_path)).collect())
    assert got == [(1, "click", 1, 50.0), (1, "error", 1, 50.0), (2, "click", 1, 100.0), (2, "error", 0, 0.0)]


def test_domains_of_over_a_thousand_values(spark):
    df = spark.range(3000).selectExpr("date_add(date'2024-01-01', cast(id div 1500 as int)) AS period", "concat('v', id % 1500) AS c")
    low = {r["rule_type"]: r for r in PR.categorical(df, "c", "CATEGORICAL_LOW", 1.0).collect()}
    assert len(set(low["ALLOWED_VALUES"]["values"])) == 1500 and low["ALLOWED_VALUES"]["coverage_pct"] == 100.0 and low["DISTINCT_COUNT_EXACT"]["lower"] == 1500
    mid = {r["rule_type"]: r for r in PR.categorical(df, "c", "CATEGORICAL_MID", 1.0).collect()}
    assert (mid["DISTINCT_COUNT_RANGE"]["lower"], mid["DISTINCT_COUNT_RANGE"]["upper"]) == (1350, 1650)
