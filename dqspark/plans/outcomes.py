"""Logs, correlation, consistency, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as X
from ..operators import profile as P
from ..operators import proposals as PR
from ..operators import results as RS
from ..rules import ir
from .registry import query, rounded, table
from .tuning import GUARD, _histories

LOG = """2026-01-01T00:00:00Z INFO:Dist:start
INFO:Dist:Resultados GDQ:
INFO:Dist:[{'rule': 'Completeness A >= 0.95', 'outcome': 'Passed', 'evaluatedmetrics': {'Column.A.Completeness': 1.0}, 'failurereason': None}, {'rule': 'Mean B between 1 and 2 [x]', 'outcome': 'Failed', 'evaluatedmetrics': '{"Column.B.Mean": "3.5"}', 'failurereason': 'Value: 3.5\\nExpectedRange: [1.0, 2.0]'}]
INFO:BookQualidades:Salvando {'Rule': 'Completeness A >= 0.95', 'Outcome': 'Passed', 'EvaluatedMetrics': {'Column.A.Completeness': 1.0}, 'FailureReason': '', 'EvaluatedRule': 'Completeness A >= 0.95'}
INFO:BookQualidades:Salvando {'Rule': 'RowCount >= 10', 'Outcome': 'Passed', 'EvaluatedMetrics': {'Dataset.*.RowCount': 'bad'}, 'EvaluatedRule': 'RowCount between 10 and 99'}"""


@query("""SELECT * FROM (VALUES (0, 'Completeness A >= 0.95', 'Passed', 'Completeness', 'A', 0.95::DOUBLE, NULL::DOUBLE, 1.0::DOUBLE), (1, 'Mean B between 1 and 2 [x]', 'Failed', 'Mean', 'B', 1.0, 2.0, 3.5), (2, 'RowCount >= 10', 'Passed', 'RowCount', '', 10.0, 99.0, 0.0))
v("position", rule, outcome, category, target_column, compiled_lower, compiled_upper, metric)""")
def log_parse(spark, sf_dir):
    out = RS.from_logs(spark.createDataFrame([("log", LOG)], "log_id string, text string"))
    return out.select("position", "rule", "outcome", "category", "target_column", "compiled_lower", "compiled_upper", F.map_values("metrics")[0].alias("metric"))


CART = [("p1", ir.COMPLETENESS, "A", "Completeness A  >= 0.95"), ("p2", ir.COMPLETENESS, "A", "Completeness A >= 0.95"), ("p3", ir.MEAN, "b", "Mean B >= 1"), ("p4", ir.ROW_COUNT, None, "RowCount >= 11"), ("p5", ir.DISTINCT, "z", "DistinctValuesCount Z = 1")]


@query("SELECT * FROM (VALUES ('p1', 0, 'text'), ('p3', 1, 'type and column'), ('p4', 2, 'type and column')) v(proposal_id, \"position\", how)")
def correlate(spark, sf_dir):
    cart = spark.createDataFrame(CART, "proposal_id string, rule_type string, column_name string, rule string")
    return RS.correlate(cart, RS.from_logs(spark.createDataFrame([("log", LOG)], "log_id string, text string")))


CHECKED = [(ir.MEAN, "a", None, 30, None, ""), (ir.STDDEV, "a", None, 15, None, ""), (ir.MEAN, "b", None, 30, None, ""), (ir.MEAN, "b", None, 30, None, ""), (ir.FREQ_STATIC, "c", "x", 30, 70.0, ""), (ir.FREQ_STATIC, "c", "y", 30, 40.0, ""), (ir.PRIMARY_KEY, None, None, 30, None, "k"), (ir.COMPLETENESS, "k", None, 30, None, ""), (ir.ROW_COUNT, None, None, 10, None, "")]


@query("SELECT * FROM (VALUES ('duplicate', 'MEAN_DUAL_GUARD:b'), ('different windows', 'a'), ('shares over 100 %', 'c'), ('covered by the key', 'k'), ('row count far from mean', 'a')) v(\"check\", target)")
def consistency_checks(spark, sf_dir):
    cart = spark.createDataFrame(CHECKED, "rule_type string, column_name string, category_value string, n int, upper double, v string").withColumn("values", F.array("v"))
    return X.inconsistencies(cart)


@query("""SELECT * FROM (VALUES ('1', 'quoted column in a built-in rule'), ('2', 'functions of past runs are lower-case'), ('2', 'unbalanced brackets'), ('3', 'CustomSql without from primary'), ('4', 'Completeness takes a lower bound'), ('5', 'key columns are separated by spaces'), ('6', 'empty rule')) v(proposal_id, warning)""")
def syntax_checks(spark, sf_dir):
    rows = [("1", 'Mean "A" >= 1'), ("2", "Mean A >= (AVG(last(3))"), ("3", 'CustomSql "select 1" >= 1'), ("4", "Completeness A between 0.1 and 0.2"), ("5", "IsPrimaryKey A, B"), ("6", " "), ("7", "RowCount >= 1")]
    return X.syntax_warnings(spark.createDataFrame(rows, "proposal_id string, rule string"))


@query()
def analysis_summary(spark, sf_dir):
    profile = P.classified(P.column_stats(table(spark, sf_dir, "orders")))
    return X.summary(profile, PR.recommended(PR.numeric(_histories(spark, sf_dir), GUARD)))


@query("SELECT count(*) AS queries, count(*) FILTER (user_id = 1) AS errors, round(avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate, round(CAST(sum(event_id) AS DOUBLE) / 1000, 3) AS seconds, CAST(sum(user_id) AS BIGINT) AS bytes, round(CAST(sum(user_id * 0.000005) AS DOUBLE), 6) AS cost_usd FROM events")
def query_log_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entries = e.select(F.when(F.col("user_id") == 1, "error").otherwise("ok").alias("status"), (F.col("user_id") % 2 == 0).alias("cached"), F.col("event_id").alias("ms"), F.col("user_id").alias("bytes"), (F.col("user_id") * 0.000005).alias("cost_usd"))
    return rounded(X.log_summary(entries))
