"""Rule results from job logs, and their correlation with the rules that were sent.

A log is a row of text. What it holds are Python or JSON literals, which SQL can't read, so one Arrow batch UDF scans them; all that
follows is DataFrame work.
"""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import ir

_CLOSING = {"[": "]", "{": "}"}
_PREFIX = re.compile(r"^(?:[\d\-T:.Z]+\s+)?(?:(?:INFO|WARNING|ERROR|DEBUG):\w+:)?\s*")
_LINE_PREFIX = re.compile(r"\n(?:[\d\-T:.Z]{8,}\s+)?(?:(?:INFO|WARNING|ERROR|DEBUG):\w+:)?")
#: The marks that results follow in a log.
LIST_MARK, SAVED_MARK, INFO_MARK = re.compile(r"Resultados GDQ:"), re.compile(r"BookQualidades:Salvando\s+(?=\{)"), re.compile(r"(?:INFO|WARNING):\w+:\s*(?=\[)")
SCHEMA = "rule string, outcome string, metrics map<string,double>, failure_reason string, evaluated_rule string"
KEY_CHARS = 100


def literal_at(text: str, start: int) -> str | None:
    """The balanced list or dictionary that begins at `start`; brackets in quotes don't count."""
    opening = text[start] if start < len(text) else ""
    if opening not in _CLOSING:
        return None
    closing, depth, quote, at = _CLOSING[opening], 0, "", start
    while at < len(text):
        ch = text[at]
        if quote:
            if ch == "\\":
                at += 1
            elif ch == quote:
                quote = ""
        elif ch in "'\"":
            quote = ch
        elif ch == opening:
            depth += 1
        elif ch == closing:
            depth -= 1
            if not depth:
                return text[start : at + 1]
        at += 1
    return None


def read_literal(text: str | None):
    """A Python literal, else JSON, else JSON with its quotes put right; None if it is none."""
    if not text:
        return None
    for reader, source in ((ast.literal_eval, text), (json.loads, text), (json.loads, text.replace("'", '"'))):
        try:
            return reader(source)
        except (ValueError, SyntaxError):
            pass
    return None


def _first_list(text: str, at: int) -> int:
    """Place of the list that follows a mark, past white space and one line's prefix."""
    for _ in range(3):
        at += len(_PREFIX.match(text[at:].lstrip())[0]) + len(text[at:]) - len(text[at:].lstrip())
        if text[at : at + 1] == "[":
            return at
    return -1


def _record(d: dict) -> dict:
    low = {str(k).lower().replace("_", ""): v for k, v in d.items()}
    metrics = low.get("evaluatedmetrics") or {}
    if isinstance(metrics, str):
        metrics = read_literal(metrics) or {}

    def number(v) -> float:
        try:
            return float(v)
        except (TypeError, ValueError):
            return 0.0

    reason = " | ".join(str(low.get("failurereason") or "").strip().split("\n"))
    return {"rule": str(low.get("rule", low.get("regragdq", "")) or ""), "outcome": str(low.get("outcome") or ""), "metrics": [(str(k), number(v)) for k, v in metrics.items()] if isinstance(metrics, dict) else [], "failure_reason": reason, "evaluated_rule": str(low.get("evaluatedrule") or "")}


def parse_log(text: str) -> list[dict]:
    """Results in the order found: of the marked lists; saved single results that say more replace them; unmarked lists if there are none."""
    def lists(places):
        for at in places:
            body = literal_at(text, at)
            for d in read_literal(body) or read_literal(_LINE_PREFIX.sub(" ", body or "")) or []:
                if isinstance(d, dict):
                    yield _record(d)

    found: dict[str, dict] = {}
    for r in lists(p for p in (_first_list(text, m.end()) for m in LIST_MARK.finditer(text)) if p >= 0):
        found.setdefault(r["rule"][:KEY_CHARS], r)
    for m in SAVED_MARK.finditer(text):
        d = read_literal(literal_at(text, m.end()))
        if isinstance(d, dict):
            r = _record(d)
            known = found.get(r["rule"][:KEY_CHARS])
            if known is None or r["evaluated_rule"] and not known["evaluated_rule"]:
                found[r["rule"][:KEY_CHARS]] = r
    if not found:
        for r in lists(m.end() for m in INFO_MARK.finditer(text)):
            found.setdefault(r["rule"][:KEY_CHARS], r)
    return list(found.values())


def from_logs(logs: DataFrame) -> DataFrame:
    """log_id, position and the result's fields, category, column, label and bounds, for logs(log_id, text)."""
    types = [("rule", pa.string()), ("outcome", pa.string()), ("metrics", pa.map_(pa.string(), pa.float64())), ("failure_reason", pa.string()), ("evaluated_rule", pa.string())]

    def run(batches):
        for batch in batches:
            for log_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parse_log(text or "")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([log_id] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), *[pa.array([r[n] for r in rows], t) for n, t in types]], ["log_id", "position", *(n for n, _ in types)])

    return described(logs.select(F.col("log_id").cast("string"), "text").mapInArrow(run, "log_id string, position int, " + SCHEMA))


_NUMBER = r"([-+0-9.eE]+)"


def _bound(column: str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit("")).try_cast("double")


def described(results: DataFrame) -> DataFrame:
    """Adds category, target column, label and compiled bounds, by patterns on the rule, the evaluated rule and the failure."""
    rule = F.trim("rule")
    sql = F.regexp_extract(rule, r'(?i)CustomSql\s+"select\s+(.*?)\s+from\s+primary', 1)
    pct, freq = F.regexp_extract(rule, r"(?i)approx_percentile\(\s*cast\((\w+)", 1), F.regexp_extract(rule, r"(?i)cast\(sum\(case\s+when\s+(\w+)", 1)
    word, target = F.regexp_extract(rule, r"^\(*(\w+)", 1), F.regexp_extract(rule, r"^\(*\w+\s+(\w+)", 1)
    category = F.when(pct != "", "Percentile").when(freq != "", "Frequency").when(F.lower(rule).contains("customsql"), "CustomSql").otherwise(word)
    column = F.when(pct != "", pct).when(freq != "", freq).when(category == "CustomSql", F.regexp_extract(sql, r"\((?:.*\()?\s*(\w+)", 1)).when(category == "RowCount", "").when(category == "IsPrimaryKey", F.trim(F.regexp_replace(rule, "^IsPrimaryKey", ""))).otherwise(target)
    short = F.when(F.length(sql) > 50, F.concat(F.substring(sql, 1, 47), F.lit("..."))).otherwise(sql)
    label = F.when(sql != "", F.concat(F.lit("CustomSql "), short)).when(category == "RowCount", "RowCount").otherwise(F.concat_ws(" ", word, target))
    between = r"(?i)between\s+" + _NUMBER + r"\s+and\s+" + _NUMBER
    low = F.coalesce(_bound("evaluated_rule", between), _bound("evaluated_rule", r">=\s*" + _NUMBER))
    high = F.coalesce(_bound("evaluated_rule", between, 2), _bound("evaluated_rule", r"<=\s*" + _NUMBER))
    span = r"ExpectedRange:\s*\[\s*" + _NUMBER + r"\s*,\s*" + _NUMBER + r"\s*\]"
    none = low.isNull() & high.isNull()
    low_f = F.coalesce(_bound("failure_reason", span), _bound("failure_reason", between), _bound("failure_reason", r">=\s*" + _NUMBER))
    high_f = F.coalesce(_bound("failure_reason", span, 2), _bound("failure_reason", between, 2))
    return results.withColumns({"category": category, "target_column": column, "label": label, "compiled_lower": F.when(none, low_f).otherwise(low), "compiled_upper": F.when(none, high_f).otherwise(high)})


def normalised(rule: Column) -> Column:
    return F.trim(F.regexp_replace(rule, r"\s+", " "))


def syntax_hash(rule: Column) -> Column:
    return F.substring(F.sha2(F.trim(rule), 256), 1, 16)


#: Rule types that a log's categories stand for.
CATEGORY_TYPES = {"mean": ir.MEAN, "standarddeviation": ir.STDDEV, "rowcount": ir.ROW_COUNT, "completeness": ir.COMPLETENESS, "columnvalues": ir.ALLOWED, "distinctvaluescount": ir.DISTINCT, "isprimarykey": ir.PRIMARY_KEY, "customsql": ir.CUSTOM}


def correlate(cart: DataFrame, results: DataFrame) -> DataFrame:
    """proposal_id, position, how: each result belongs to one rule at most.

    First by text, the k-th of equal texts to the k-th; then what is left by rule type and column, where one rule is left.
    cart has proposal_id, rule_type, column_name, rule; results has position, rule, category, target_column.
    """
    c = cart.where(F.trim("rule") != "").withColumn("_key", normalised(F.col("rule")))
    c = c.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("proposal_id")))
    r = results.withColumn("_key", normalised(F.col("rule"))).withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("position")))
    by_text = c.join(r.select("_key", "_k", "position"), ["_key", "_k"]).select("proposal_id", "position", F.lit("text").alias("how"))
    kind = F.lower(F.regexp_replace("category", " ", ""))
    mapped = F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORY_TYPES.items() for x in kv])[kind], kind)
    rest_c = c.join(by_text.select("proposal_id"), "proposal_id", "left_anti").select("proposal_id", F.col("rule_type").alias("_t"), F.lower(F.coalesce("column_name", F.lit(""))).alias("_c"))
    rest_c = rest_c.withColumn("_n", F.count("*").over(Window.partitionBy("_t", "_c"))).where("_n = 1")
    rest_r = r.join(by_text.select("position"), "position", "left_anti").select("position", mapped.alias("_t"), F.lower(F.coalesce("target_column", F.lit(""))).alias("_c"))
    rest_r = rest_r.withColumn("_k", F.row_number().over(Window.partitionBy("_t", "_c").orderBy("position"))).where("_k = 1")
    by_kind = rest_c.join(rest_r, ["_t", "_c"]).select("proposal_id", "position", F.lit("type and column").alias("how"))
    return by_text.unionByName(by_kind)


def written_back(cart: DataFrame, results: DataFrame, tested_at: str) -> tuple[DataFrame, DataFrame]:
    """The cart with its results, and one row of counts: matched, orphaned results, unmatched rules."""
    met = correlate(cart, results)
    out = cart.join(met, "proposal_id", "left").join(results.select("position", "outcome", "metrics", "failure_reason", "compiled_lower", "compiled_upper"), "position", "left")
    out = out.withColumns({"tested_at": F.when(F.col("position").isNotNull(), F.lit(tested_at)), "tested_hash": F.when(F.col("position").isNotNull(), syntax_hash(F.col("rule")))})
    counts = met.agg(F.count("*").alias("matched")).crossJoin(results.join(met, "position", "left_anti").agg(F.count("*").alias("orphaned"))).crossJoin(cart.where(F.trim("rule") != "").join(met, "proposal_id", "left_anti").agg(F.count("*").alias("unmatched")))  # one row each
    return out, counts


def stale(cart: DataFrame) -> DataFrame:
    """Tested rules whose text has changed since."""
    return cart.where(F.col("tested_hash").isNotNull() & (F.col("tested_hash") != syntax_hash(F.col("rule"))))
