"""Rules on their way out: text checks, consistency, reports, payloads, summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import ir

BUILT_IN = "Mean|StandardDeviation|Completeness|ColumnValues|DistinctValuesCount|RowCount"
LOW_COVERAGE = 80.0
CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.5, "LOW": 0.0}
TROUBLED = ("STRUCTURAL_BREAK", "SPARSE", "ZERO_INFLATED", "VOLATILE")


def _count(column, mark: str):
    return F.length(column) - F.length(F.replace(column, F.lit(mark), F.lit("")))


def syntax_warnings(rules: DataFrame) -> DataFrame:
    """proposal_id, warning for rules(proposal_id, rule)."""
    r = F.trim("rule")
    sql = r.contains("CustomSql")
    checks = [
        (r == "", "empty rule"), (_count(r, "(") != _count(r, ")"), "unbalanced brackets"), (r.rlike(rf'({BUILT_IN})\s+"\w+"'), "quoted column in a built-in rule"), (r.rlike(r"(AVG|STD|LAST)\("), "functions of past runs are lower-case"),
        (sql & (_count(r, '"') % 2 != 0), "unbalanced quotes in CustomSql"), (sql & ~F.lower(r).contains("from primary"), "CustomSql without from primary"),
        (r.contains("Completeness") & F.lower(r).contains("between"), "Completeness takes a lower bound"), (r.contains("IsPrimaryKey") & r.contains(","), "key columns are separated by spaces"),
    ]
    found = F.filter(F.array(*[F.when(c, w) for c, w in checks]), lambda x: x.isNotNull())
    return rules.select("proposal_id", F.explode(found).alias("warning"))


def inconsistencies(cart: DataFrame) -> DataFrame:
    """check, target: duplicates, means and deviations over different windows, static shares over 100 %, keys with completeness, row counts far from means.

    cart has rule_type, column_name, category_value, n, upper, values.
    """
    target = F.coalesce("column_name", F.lit("(table)"))
    twice = cart.groupBy("rule_type", target.alias("t"), F.coalesce("category_value", F.lit("")).alias("c")).agg(F.count("*").alias("k")).where("k > 1")
    twice = twice.select(F.lit("duplicate").alias("check"), F.concat_ws(":", "rule_type", "t", F.nullif("c", F.lit(""))).alias("target"))
    spread = cart.where(F.col("rule_type").isin(ir.MEAN, ir.STDDEV)).groupBy("column_name").agg(F.count_distinct(F.coalesce("n", F.lit(30))).alias("k")).where("k > 1").select(F.lit("different windows"), "column_name")
    shares = cart.where(F.col("rule_type") == ir.FREQ_STATIC).groupBy(target.alias("t")).agg(F.count("*").alias("k"), F.sum("upper").alias("u")).where("k >= 2 AND u > 100").select(F.lit("shares over 100 %"), "t")
    keys = cart.where(F.col("rule_type") == ir.PRIMARY_KEY).select(F.explode("values").alias("column_name")).distinct()
    covered = cart.where(F.col("rule_type") == ir.COMPLETENESS).join(keys, "column_name", "left_semi").select(F.lit("covered by the key"), "column_name")
    rows = cart.where(F.col("rule_type") == ir.ROW_COUNT).agg(F.first("n").alias("_rn"))
    apart = cart.where(F.col("rule_type") == ir.MEAN).crossJoin(F.broadcast(rows)).where(F.abs(F.col("n") - F.col("_rn")) > 15).agg(F.min("column_name").alias("c")).where("c IS NOT NULL").select(F.lit("row count far from mean"), "c")  # one row
    return twice.union(spread).union(shares).union(covered).union(apart)


def rules_text(cart: DataFrame) -> str:
    """Enabled rules, one per line, in the cart's order."""
    rows = cart.where("enabled").where(F.trim("rule") != "").orderBy("position").select("rule").collect()
    return "\n".join(r["rule"].strip() for r in rows)


def write_rules(cart: DataFrame, path: str) -> None:
    """The same as a text sink: one file, a rule a line."""
    cart.where("enabled").where(F.trim("rule") != "").orderBy("position").select("rule").coalesce(1).write.mode("overwrite").text(path)


def report(proposals: DataFrame, title: str = "Rules") -> str:
    """Markdown, by tier and score."""
    rank = {"RECOMMENDED": 0, "POSSIBLE": 1, "NOT_RECOMMENDED": 2}
    rows = sorted((r.asDict() for r in proposals.collect()), key=lambda r: (rank.get(r["tier"], 3), -r["score_total"]))
    lines = [f"# {title}", ""]
    for r in rows:
        lines += [f"## {r['rule_type']} {r['column_name'] or '(table)'}", f"- tier: {r['tier']} ({r['category']}), score {r['score_total']:.2f}, confidence {r['confidence']}"]
        if r["total_periods"] is not None:
            lines.append(f"- backtest: {r['coverage_pct']:.1f} % of {r['total_periods']} periods, {r['false_positive_proxy']} false positives")
        lines += [*(f"- {x}" for x in r["reasons"] or ()), ""]
    return "\n".join(lines)


def rule_columns(cart: DataFrame) -> DataFrame:
    """column_name: upper-case names that enabled rules refer to: their columns, key columns, and the column that a condition begins with.

    cart has enabled, rule_type, column_name, values, and may have a condition.
    """
    own = F.when(F.col("rule_type").isin(ir.PRIMARY_KEY, ir.UNIQUENESS), F.col("values")).otherwise(F.array("column_name"))
    where = F.regexp_extract("condition", r"^[(\s]*([A-Za-z_]\w*)", 1) if "condition" in cart.columns else F.lit(None).cast("string")
    names = cart.where("enabled").select(F.explode(F.concat(own, F.array(where))).alias("c"))
    return names.where(F.col("c").isNotNull() & (F.col("c") != "")).select(F.upper("c").alias("column_name")).distinct()


def payload(cart: DataFrame, dataset: str, partitions: list[str], columns: list[str] | None = None) -> str:
    """The job's JSON, upper-case keys, rules under VARIAVEIS.GDQ; columns are found in the rules unless they are named."""
    columns = [r["column_name"] for r in rule_columns(cart).collect()] if columns is None else columns
    rules = [{"REGRAGDQ": line} for line in rules_text(cart).split("\n") if line]
    return json.dumps({"TABELA": dataset, "PARTICOES": partitions, "COLUNAS": sorted({c.upper() for c in columns}), "VARIAVEIS": {"GDQ": [{"RegraGDQ": r["REGRAGDQ"]} for r in rules]}})


def summary(profile: DataFrame, proposals: DataFrame) -> DataFrame:
    """measure, key, value: columns by type, proposals by category, coverage and low coverage, troubled regimes."""
    by_type = profile.groupBy(F.col("semantic_type").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("columns").alias("measure"), "key", "value")
    by_category = proposals.groupBy(F.col("category").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("proposals"), "key", "value")
    fine = proposals.where((F.col("tier") != "NOT_RECOMMENDED") & F.col("total_periods").isNotNull())
    cover = fine.agg(F.round(F.avg("coverage_pct"), 1).alias("value")).select(F.lit("average coverage"), F.lit(""), F.coalesce("value", F.lit(0.0)))
    low = fine.agg(F.count_if(F.col("coverage_pct") < LOW_COVERAGE).cast("double").alias("value")).select(F.lit("low coverage"), F.lit(""), "value")
    out = by_type.union(by_category).union(cover).union(low)
    if "regime" in proposals.columns:
        out = out.union(proposals.where(F.col("regime").isin(*TROUBLED)).groupBy("regime").agg(F.count_distinct("column_name").cast("double").alias("value")).select(F.lit("regime"), "regime", "value"))
    return out


def log_summary(entries: DataFrame) -> DataFrame:
    """Queries, errors, cache hits, seconds, bytes and cost of a query log."""
    return entries.agg(
        F.count("*").alias("queries"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.avg(F.when(F.col("cached"), 1.0).otherwise(0.0)), 4).alias("hit_rate"), F.round(F.sum("ms") / 1000, 3).alias("seconds"),
        F.sum("bytes").cast("long").alias("bytes"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


def newest(entries: DataFrame, n: int = 20, **equal) -> DataFrame:
    """The newest entries of a query log, of those only whose columns equal what is named: status, name, dataset, column_name, cached."""
    for column, value in equal.items():
        entries = entries.where(F.col(column) == F.lit(value))
    return entries.orderBy(F.col("at").desc()).limit(n)
