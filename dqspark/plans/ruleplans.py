"""Rule text and rule execution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..rules import evaluate as E
from ..rules import ir, render
from ..rules.ir import Guard, Rule
from . import base as B
from .registry import query, rounded, table

GUARD = Guard(10, 2.0, 0.10)
MEAN_RULE, STD_RULE, COUNT_RULE = (render.render(Rule(k, c, GUARD)) for k, c in ((ir.MEAN, "v"), (ir.STDDEV, "v"), (ir.ROW_COUNT, None)))


def _runs_sql(metric: str, name: str, buffer: float = 0.01) -> str:
    lo, hi = f"(m - 2 * sd - {buffer})", f"(m + 2 * sd + {buffer})"
    mlo, mhi = f"(m * 0.9 - {buffer})", f"(m * 1.1 + {buffer})"
    return f"""WITH {B.EVENTS}, s AS (SELECT period, {metric} AS value FROM ev GROUP BY period),
b AS (SELECT period, value, avg(value) OVER w AS m, CASE WHEN count(value) OVER w > 0 THEN coalesce(stddev_samp(value) OVER w, 0.0) END AS sd FROM s WINDOW w AS (ORDER BY period ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT period AS run, '{name}' AS rule_id, CASE WHEN {B.inside('value', lo, hi)} OR {B.inside('value', mlo, mhi)} THEN 'Passed' ELSE 'Failed' END AS outcome, round(value, 6) AS metric, round({lo}, 6) AS lower_bound, round({hi}, 6) AS upper_bound FROM b"""


def _runs(spark, sf_dir, name, rule):
    out = E.evaluate_runs(B.events(spark, sf_dir), {name: rule}, "period")
    return rounded(out.select("run", "rule_id", "outcome", F.map_values("metrics")[0].alias("metric"), "lower_bound", "upper_bound"))


@query(_runs_sql("avg(v)", "mean"))
def eval_mean_dual_guard(spark, sf_dir):
    return _runs(spark, sf_dir, "mean", MEAN_RULE)


@query(_runs_sql("stddev_samp(v)", "stddev"))
def eval_stddev(spark, sf_dir):
    return _runs(spark, sf_dir, "stddev", STD_RULE)


@query(_runs_sql("CAST(count(*) AS DOUBLE)", "rows", 0.0))
def eval_rowcount(spark, sf_dir):
    return _runs(spark, sf_dir, "rows", COUNT_RULE)


def _one(spark, sf_dir, df, rules):
    out = E.evaluate(df, rules)
    return rounded(out.select("rule_id", "outcome", F.map_values("metrics")[0].alias("metric"), "lower_bound", "upper_bound"))


def _one_sql(name: str, metric: str, passed: str, source: str, lower="NULL", upper="NULL") -> str:
    return f"SELECT '{name}' AS rule_id, CASE WHEN {passed} THEN 'Passed' ELSE 'Failed' END AS outcome, round(CAST(m AS DOUBLE), 6) AS metric, CAST({lower} AS DOUBLE) AS lower_bound, CAST({upper} AS DOUBLE) AS upper_bound FROM (SELECT {metric} AS m FROM {source}) q"


@query(f"WITH {B.EVENTS} " + _one_sql("full", "count(v) / count(*)", "m >= 0.94", "ev", "0.94"))
def eval_completeness(spark, sf_dir):
    return _one(spark, sf_dir, B.events(spark, sf_dir), {"full": render.render(Rule(ir.COMPLETENESS, "v", lower=0.94))})


@query(_one_sql("status", "count(*) FILTER (o_orderstatus IN ('F', 'O')) / count(*)", "m >= 1", "orders"))
def eval_column_values(spark, sf_dir):
    return _one(spark, sf_dir, table(spark, sf_dir, "orders"), {"status": render.render(Rule(ir.ALLOWED, "o_orderstatus", values=("F", "O")))})


@query(_one_sql("prio", "count(DISTINCT o_orderpriority)", "m = 5", "orders"))
def eval_distinct(spark, sf_dir):
    return _one(spark, sf_dir, table(spark, sf_dir, "orders"), {"prio": render.render(Rule(ir.DISTINCT, "o_orderpriority", lower=5))})


@query(_one_sql("range", "count(DISTINCT o_custkey)", "m BETWEEN 100 AND 100000", "orders", "100", "100000"))
def eval_distinct_range(spark, sf_dir):
    return _one(spark, sf_dir, table(spark, sf_dir, "orders"), {"range": render.render(Rule(ir.DISTINCT_RANGE, "o_custkey", lower=100, upper=100000))})


@query(_one_sql("key", "CASE WHEN count(DISTINCT l_orderkey || '|' || l_linenumber) = count(*) THEN 1.0 ELSE 0.0 END", "m = 1", "lineitem"))
def eval_primary_key(spark, sf_dir):
    return _one(spark, sf_dir, table(spark, sf_dir, "lineitem"), {"key": render.render(Rule(ir.PRIMARY_KEY, values=("l_orderkey", "l_linenumber")))})


@query(_one_sql("uniq", "count(DISTINCT l_orderkey || '||' || l_linenumber) * 100.0 / count(*)", "m >= 100", "lineitem", "100"))
def eval_uniqueness(spark, sf_dir):
    return _one(spark, sf_dir, table(spark, sf_dir, "lineitem"), {"uniq": render.render(Rule(ir.UNIQUENESS, values=("l_orderkey", "l_linenumber")))})


@query(_one_sql("share", "count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*)", "m BETWEEN 20 AND 60", "orders WHERE o_orderpriority = '1-URGENT'", "20", "60"))
def eval_custom_sql(spark, sf_dir):
    rule = Rule(ir.FREQ_STATIC, "o_orderstatus", lower=20.0, upper=60.0, category="F")
    return _one(spark, sf_dir, table(spark, sf_dir, "orders"), {"share": render.render_where(rule, "o_orderpriority = '1-URGENT'")})


@query("""WITH h AS (SELECT CAST(ts AS DATE) AS run, avg(value) AS value FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-30' GROUP BY 1), l AS (SELECT * FROM h ORDER BY run DESC LIMIT 10), st AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM l),
x AS (SELECT avg(value) AS v, count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-30')
SELECT 'mean' AS rule_id, CASE WHEN v BETWEEN m - 2 * sd - 0.01 AND m + 2 * sd + 0.01 OR v BETWEEN m * 0.9 - 0.01 AND m * 1.1 + 0.01 THEN 'Passed' ELSE 'Failed' END AS outcome, round(v, 6) AS metric, round(m - 2 * sd - 0.01, 6) AS lower_bound, round(m + 2 * sd + 0.01, 6) AS upper_bound, CAST(NULL AS VARCHAR) AS failure_reason FROM st, x
UNION ALL SELECT 'rows', 'Failed', CAST(n AS DOUBLE), NULL, NULL, 'insufficient history or no rows' FROM x UNION ALL SELECT 'some', 'Passed', CAST(n AS DOUBLE), 1.0, NULL, NULL FROM x""")
def rule_results(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("run", F.to_date("ts"))
    before = ev.where("run < DATE '2024-01-30'").groupBy("run").agg(F.avg("value").alias("value")).withColumn("metric", F.lit("mean:value"))
    rules = {"mean": render.render(Rule(ir.MEAN, "value", GUARD)), "rows": COUNT_RULE, "some": "RowCount >= 1"}
    out = E.evaluate(ev.where("run = DATE '2024-01-30'"), rules, before)
    outcome = out.withColumn("failure_reason", F.when(F.col("outcome") == "Failed", F.col("failure_reason")))
    return rounded(outcome.select("rule_id", "outcome", F.map_values("metrics")[0].alias("metric"), "lower_bound", "upper_bound", "failure_reason"))


TEXT_RULES = {
    "mean": Rule(ir.MEAN, "vlr_x", Guard(30, 2.0, 0.10)), "stddev": Rule(ir.STDDEV, "vlr_x", Guard(15, 2.5, 0.05, False)), "rows": Rule(ir.ROW_COUNT, None, Guard(30, 2, 0.10)), "full": Rule(ir.COMPLETENESS, "a", lower=0.95),
    "allowed": Rule(ir.ALLOWED, "a", values=("1", "B", "null")), "distinct": Rule(ir.DISTINCT, "a", lower=4.0), "range": Rule(ir.DISTINCT_RANGE, "a", lower=3, upper=9), "key": Rule(ir.PRIMARY_KEY, values=("a", "b")),
    "static": Rule(ir.FREQ_STATIC, "a", lower=1.5, upper=9.0, category="O'K"), "uniq": Rule(ir.UNIQUENESS, values=("a", "b")),
}
_MEAN = "(((Mean VLR_X >= (avg(last(30)) - (2 * std(last(30))) - 0.01)) AND (Mean VLR_X <= (avg(last(30)) + (2 * std(last(30))) + 0.01))) OR ((Mean VLR_X >= (avg(last(30)) * 0.9) - 0.01) AND (Mean VLR_X <= (avg(last(30)) * 1.1) + 0.01)))"
_STD = "((StandardDeviation VLR_X >= (avg(last(15)) - (2.5 * std(last(15))) - 0.01)) AND (StandardDeviation VLR_X <= (avg(last(15)) + (2.5 * std(last(15))) + 0.01)))"
_ROWS = "(((RowCount >= (avg(last(30)) * 1.0 - (2.0 * std(last(30))))) AND (RowCount <= (avg(last(30)) * 1.0 + (2.0 * std(last(30)))))) OR ((RowCount >= (avg(last(30)) - (avg(last(30)) * 0.1))) AND (RowCount <= (avg(last(30)) + (avg(last(30)) * 0.1)))))"
_FREQ = "select cast(sum(case when A = ''O''''K'' then 1 else 0 end) as double) * 100.0 / count(*) from primary"
TEXTS = {
    "mean": _MEAN, "stddev": _STD, "rows": _ROWS, "full": "Completeness A >= 0.95", "allowed": 'ColumnValues A in [1, "B", NULL]', "distinct": "DistinctValuesCount A = 4", "range": "(DistinctValuesCount A >= 3) AND (DistinctValuesCount A <= 9)", "key": "IsPrimaryKey A B",
    "static": f'(CustomSql "{_FREQ}" >= 1.5000) AND (CustomSql "{_FREQ}" <= 9.0000)', "uniq": "CustomSql \"select cast(count(distinct concat(cast(A as varchar), ''||'', cast(B as varchar))) as double) * 100.0 / count(*) from primary\" >= 100.0",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TEXTS.items()) + ") v(rule_id, rule)")
def rule_text(spark, sf_dir):
    return spark.createDataFrame([(k, render.render(r)) for k, r in TEXT_RULES.items()], "rule_id string, rule string")


_W = "d = date_format(add_months(current_date(), -1), ''yyyyMM'')"


@query(f"""SELECT * FROM (VALUES ('full', 'CustomSql "select cast(count(A) as double) / nullif(count(*), 0) from primary where {_W}" >= 0.95'), ('allowed', 'CustomSql "select cast(count(case when cast(A as varchar) not in (''1'', ''B'') then 1 end) as double) from primary where {_W}" = 0'),
('distinct', 'CustomSql "select cast(count(distinct A) as double) from primary where {_W}" = 4'), ('key', NULL),
('stddev', '((CustomSql "select stddev(cast(VLR_X as double)) from primary where {_W}" >= (avg(last(15)) - (2.5 * std(last(15))) - 0.01)) AND (CustomSql "select stddev(cast(VLR_X as double)) from primary where {_W}" <= (avg(last(15)) + (2.5 * std(last(15))) + 0.01)))')) v(rule_id, rule)""")
def rule_text_filtered(spark, sf_dir):
    where = render.date_condition("d", "MONTH", "LAG_N", 1)
    return spark.createDataFrame([(k, render.render_where(TEXT_RULES[k], where)) for k in ("full", "allowed", "distinct", "key", "stddev")], "rule_id string, rule string")


@query("""SELECT * FROM (VALUES ('day', 'd = date_format(current_date(), ''yyyyMMdd'')'), ('lag', 'd = cast(date_format(date_sub(current_date(), 2), ''yyyyMMdd'') as int)'), ('month', 'd = date_format(add_months(current_date(), -3), ''yyyyMM'')'),
('year', 'd = date_format(add_months(current_date(), -24), ''yyyy'')'), ('latest', 'd = (select max(d) from primary)'), ('none', NULL)) v(name, condition)""")
def date_filter_expr(spark, sf_dir):
    d = render.date_condition
    rows = [("day", d("d", "DAY")), ("lag", d("d", "DAY", "LAG_N", 2, True)), ("month", d("d", "MONTH", "LAG_N", 3)), ("year", d("d", "YEAR", "LAG_N", 2)), ("latest", d("d", "DAY", "MAX_VALUE")), ("none", d("d", "NONE"))]
    return spark.createDataFrame(rows, "name string, condition string")


