"""Execution of rules on a DataFrame: all metrics in one aggregate, past runs from a metrics history.

Predicates are Columns over one row of metrics (or one row per run), so any number of rules costs one scan; only CustomSql
that isn't a plain aggregate of the table takes a query of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import identifier
from ..operators.series import EPS
from . import parse as P

_PLAIN = re.compile(r"\s*select\s+(?P<what>.+?)\s+from\s+primary\s*", re.IGNORECASE | re.DOTALL)
_VARCHAR = re.compile(r"\bas\s+varchar\b(?!\s*\()", re.IGNORECASE)
VIEW = "primary"


def _names(df: DataFrame) -> dict[str, str]:
    return {c.lower(): c for c in df.columns}


def spark_sql(sql: str) -> str:
    """Text casts that Spark doesn't know become string."""
    return _VARCHAR.sub("as string", sql)


def is_aggregate(metric: P.Metric) -> bool:
    if metric.name != "customsql":
        return True
    m = _PLAIN.fullmatch(metric.args[0])
    return bool(m) and "select" not in m["what"].lower()


def metric_column(metric: P.Metric, names: dict[str, str], allowed: tuple = ()) -> Column:
    """The metric as an aggregate, a double."""
    c = [F.col(f"`{names[identifier(a)]}`") for a in metric.args] if metric.name != "customsql" else []
    total = F.count(F.lit(1))
    share = F.when(total > 0, F.lit(1.0))
    if metric.name == "rowcount":
        out = total
    elif metric.name == "mean":
        out = F.avg(c[0].cast("double"))
    elif metric.name == "standarddeviation":
        out = F.stddev_samp(c[0].cast("double"))
    elif metric.name == "completeness":
        out = share * F.count(c[0]) / F.when(total > 0, total)
    elif metric.name == "distinctvaluescount":
        out = F.count_distinct(c[0])
    elif metric.name == "uniqueness":
        out = share * F.count_distinct(c[0]) / F.when(total > 0, total)
    elif metric.name == "columnvalues":
        known = [v for v in allowed if v is not None]
        inside = F.coalesce(c[0].cast("string").isin(*known) if known else F.lit(False), F.lit(None in allowed))
        out = share * F.count_if(inside) / F.when(total > 0, total)
    elif metric.name == "isprimarykey":
        parts = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(c)])
        some_null = F.lit(False)
        for x in c:
            some_null = some_null | x.isNull()
        out = F.when((F.count_distinct(F.when(~some_null, parts)) == total) & (F.count_if(some_null) == 0), 1.0).otherwise(0.0)
    else:
        out = F.expr(spark_sql(_PLAIN.fullmatch(metric.args[0])["what"]))
    return out.cast("double")


class Plan:
    """Parsed rules with the metrics they need; a list of allowed values is part of its metric."""

    def __init__(self, rules: dict[str, str]):
        self.rules = rules
        self.trees = {name: P.parse(text) for name, text in rules.items()}
        self.keys: dict[tuple, str] = {}
        for tree in self.trees.values():
            for c in P.walk(tree):
                self.keys.setdefault(self.slot(c), f"m{len(self.keys)}")

    @staticmethod
    def slot(c: P.Compare) -> tuple:
        return (c.metric, c.value if c.op == "in" else ())

    def spans(self) -> dict[tuple, set[int]]:
        out: dict[tuple, set[int]] = {}
        for tree in self.trees.values():
            for c in P.walk(tree):
                if c.op != "in":
                    out.setdefault(self.slot(c), set()).update(P.spans_of(c.value))
        return out

    def value(self, v, slot, past) -> Column:
        if isinstance(v, P.Past):
            return past(self.keys[slot], v)
        if isinstance(v, P.Arithmetic):
            a, b = self.value(v.left, slot, past), self.value(v.right, slot, past)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[v.op] if v.op != "/" else a / F.when(b != 0, b)
        return F.lit(float(v))

    def predicate(self, tree, past) -> Column:
        if isinstance(tree, P.Bool):
            parts = [self.predicate(p, past) for p in tree.parts]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if tree.op == "and" else (out | p)
            return out
        slot = self.slot(tree)
        x = F.col(self.keys[slot])
        if tree.op == "in":
            return x >= 1.0 - EPS
        y = self.value(tree.value, slot, past)
        slack = EPS * F.greatest(F.lit(1.0), F.abs(y))
        return {">=": x >= y - slack, "<=": x <= y + slack, ">": x > y + slack, "<": x < y - slack, "=": F.abs(x - y) <= slack, "!=": F.abs(x - y) > slack}[tree.op]

    def bound(self, tree, op: str, past) -> Column:
        """Value of the first comparison with that operator."""
        first = next((c for c in P.walk(tree) if c.op == op), None)
        return self.value(first.value, self.slot(first), past) if first else F.lit(None).cast("double")

    def results(self, past) -> Column:
        """Array with a struct per rule."""
        out = []
        for name, tree in self.trees.items():
            slots = list(dict.fromkeys(self.slot(c) for c in P.walk(tree)))
            metrics = F.create_map(*[x for s in slots for x in (F.lit(s[0].key), F.col(self.keys[s]))])
            passed = F.coalesce(self.predicate(tree, past), F.lit(False))
            unknown = self.predicate(tree, past).isNull()
            reason = F.when(unknown, "insufficient history or no rows").when(~passed, "metric outside its bounds")
            out.append(F.struct(F.lit(name).alias("rule_id"), F.lit(self.rules[name]).alias("rule"), F.when(passed, "Passed").otherwise("Failed").alias("outcome"), metrics.alias("metrics"), self.bound(tree, ">=", past).alias("lower_bound"), self.bound(tree, "<=", past).alias("upper_bound"), reason.alias("failure_reason")))
        return F.array(*out)


def _aggregates(plan: Plan, df: DataFrame) -> list[Column]:
    names = _names(df)
    return [metric_column(m, names, allowed).alias(k) for (m, allowed), k in plan.keys.items() if is_aggregate(m)]


def run_metrics(df: DataFrame, plan: Plan) -> DataFrame:
    """One row: the metrics of this run, by slot."""
    row = df.agg(*(_aggregates(plan, df) or [F.count(F.lit(1)).alias("_rows")]))
    others = [(m, k) for (m, _), k in plan.keys.items() if not is_aggregate(m)]
    if others:
        df.createOrReplaceTempView(VIEW)
        for m, k in others:
            one = df.sparkSession.sql(spark_sql(m.args[0])).limit(1)
            row = row.crossJoin(F.broadcast(one.select(F.col(f"`{one.columns[0]}`").cast("double").alias(k))))  # one row
    return row


def evaluate(df: DataFrame, rules: dict[str, str], history: DataFrame | None = None) -> DataFrame:
    """rule_id, rule, outcome, metrics, lower_bound, upper_bound, failure_reason of one run.

    history has (metric, run, value) of earlier runs; the last n are those with the largest run.
    """
    plan = Plan(rules)
    row = run_metrics(df, plan)
    spans = plan.spans()
    past_columns: dict[str, str] = {}
    if history is not None and any(spans.values()):
        ranked = history.withColumn("_rn", F.row_number().over(Window.partitionBy("metric").orderBy(F.col("run").desc())))
        aggs = []
        for (metric, _), ns in spans.items():
            for n in sorted(ns):
                v = F.when((F.col("metric") == metric.key) & (F.col("_rn") <= n), F.col("value"))
                name = f"{plan.keys[(metric, ())]}_{n}"
                aggs += [F.avg(v).alias(f"avg_{name}"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"std_{name}")]
                past_columns[name] = name
        row = row.crossJoin(F.broadcast(ranked.agg(*aggs)))  # one row

    def past(key: str, p: P.Past) -> Column:
        name = f"{key}_{p.n}"
        return F.col(f"{p.what}_{name}") if name in past_columns else F.lit(None).cast("double")

    return row.select(F.explode(plan.results(past)).alias("r")).select("r.*")


def evaluate_runs(df: DataFrame, rules: dict[str, str], run: str) -> DataFrame:
    """The same for every value of `run` at once, each against the runs before it: one aggregate, one window over runs."""
    plan = Plan(rules)
    row = df.groupBy(F.col(run).alias("run")).agg(*_aggregates(plan, df))
    columns = {}
    for slot, ns in plan.spans().items():
        k = plan.keys[slot]
        for n in sorted(ns):
            w = Window.orderBy("run").rowsBetween(-n, -1)  # a row per run, some hundreds
            columns[f"avg_{k}_{n}"] = F.avg(k).over(w)
            columns[f"std_{k}_{n}"] = F.when(F.count(k).over(w) > 0, F.coalesce(F.stddev_samp(k).over(w), F.lit(0.0)))
    row = row.withColumns(columns) if columns else row
    return row.select("run", F.explode(plan.results(lambda key, p: F.col(f"{p.what}_{key}_{p.n}"))).alias("r")).select("run", "r.*")


def metric_rows(df: DataFrame, rules: dict[str, str], run) -> DataFrame:
    """(metric, run, value): what to append to the history after a run."""
    plan = Plan(rules)
    pairs = [F.struct(F.lit(m.key).alias("metric"), F.col(k).alias("value")) for (m, _), k in plan.keys.items()]
    return run_metrics(df, plan).select(F.explode(F.array(*pairs)).alias("p")).select("p.metric", F.lit(run).alias("run"), "p.value")
