"""Rules as text of the data-quality language.

Numbers are written as Python writes them, which is why this happens on the driver: whole sigmas without a fraction but for row
counts, factors of built-in metrics to four digits and those of CustomSql to two, and a buffer but for row counts.
"""

from __future__ import annotations

from ..operators.profile import NUMERIC_TYPES, base_type
from . import ir
from .ir import Guard, Rule

_METRIC = {ir.MEAN: "Mean", ir.STDDEV: "StandardDeviation", ir.ROW_COUNT: "RowCount"}


def sigma_text(k: float, keep_fraction: bool = False) -> str:
    if k != int(k):
        return f"{k}"
    return f"{k:.1f}" if keep_fraction else str(int(k))


def band(subject: str, lower: str, upper: str) -> str:
    """subject between two expressions."""
    return f"(({subject} >= {lower}) AND ({subject} <= {upper}))"


def either(sigma: str, margin: str | None) -> str:
    return sigma if margin is None else f"({sigma} OR {margin})"


def metric_guard(metric: str, column: str | None, g: Guard) -> str:
    """A dual guard on a built-in metric."""
    subject = f"{metric} {column.upper()}" if column else metric
    mean, spread = f"avg(last({g.n}))", f"std(last({g.n}))"
    if metric == "RowCount":
        reach = f"({sigma_text(float(g.k), True)} * {spread})"
        sigma = band(subject, f"({mean} * 1.0 - {reach})", f"({mean} * 1.0 + {reach})")
        margin = band(subject, f"({mean} - ({mean} * {g.margin}))", f"({mean} + ({mean} * {g.margin}))")
    else:
        reach, slack = f"({sigma_text(g.k)} * {spread})", g.buffer > 0
        sigma = band(subject, f"({mean} - {reach}" + (f" - {g.buffer})" if slack else ")"), f"({mean} + {reach}" + (f" + {g.buffer})" if slack else ")"))
        low, high = (f"({mean} * {round(f, 4)})" for f in (1 - g.margin, 1 + g.margin))
        margin = band(subject, low + (f" - {g.buffer}" if slack else ""), high + (f" + {g.buffer}" if slack else ""))
    return either(sigma, margin if g.margin_enabled else None)


def sql_guard(sql: str, g: Guard) -> str:
    """A dual guard on a CustomSql metric; with a floor or ceiling these must hold too, if the margin is enabled."""
    subject, mean, spread = f'CustomSql "{sql}"', f"avg(last({g.n}))", f"std(last({g.n}))"
    reach = f"({sigma_text(g.k)} * {spread})"
    sigma = band(subject, f"({mean} - {reach} - {g.buffer})", f"({mean} + {reach} + {g.buffer})")
    if not g.margin_enabled:
        return sigma
    margin = band(subject, f"({mean} * {round(1 - g.margin, 2)} - {g.buffer})", f"({mean} * {round(1 + g.margin, 2)} + {g.buffer})")
    text = either(sigma, margin)
    if g.floor > 0 or g.ceiling < 100:
        text = f"({text} AND {band(subject, f'{g.floor:.4f}', f'{g.ceiling:.4f}')})"
    return text


def fixed_band(sql: str, lower: float, upper: float) -> str:
    return f'(CustomSql "{sql}" >= {lower:.4f}) AND (CustomSql "{sql}" <= {upper:.4f})'


def list_value(value) -> str:
    """NULL and numbers bare, text in double quotes."""
    text = str(value)
    if text.upper() == "NULL":
        return "NULL"
    try:
        float(text)
    except ValueError:
        return f'"{text}"'
    return text


def sql_value(value: str, column_type: str) -> str:
    if base_type(column_type) in NUMERIC_TYPES:
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def frequency_sql(rule: Rule, where: str | None = None) -> str:
    tail = f" where {where}" if where else ""
    return f"select cast(sum(case when {rule.column.upper()} = {sql_value(rule.category or '', rule.column_type)} then 1 else 0 end) as double) * 100.0 / count(*) from primary{tail}"


def _or(value, default):
    return default if value is None else value


def render(rule: Rule, text_type: str = "varchar") -> str:
    """The rule's text. `text_type` is what values are cast to inside SQL: varchar as shipped, string for Spark."""
    kind, g = rule.rule_type, rule.guard
    name = rule.column.upper() if rule.column else ""
    if kind in _METRIC:
        return metric_guard(_METRIC[kind], rule.column if kind != ir.ROW_COUNT else None, g)
    if kind == ir.COMPLETENESS:
        return f"Completeness {name} >= {_or(rule.lower, 1.0):.2f}"
    if kind == ir.ALLOWED:
        return f"ColumnValues {name} in [{', '.join(map(list_value, rule.values))}]"
    if kind == ir.DISTINCT:
        return f"DistinctValuesCount {name} = {int(_or(rule.lower, 0))}"
    if kind == ir.DISTINCT_RANGE:
        return f"(DistinctValuesCount {name} >= {int(_or(rule.lower, 0))}) AND (DistinctValuesCount {name} <= {int(_or(rule.upper, 0))})"
    if kind == ir.PRIMARY_KEY:
        return "IsPrimaryKey " + " ".join(c.upper() for c in rule.values)
    if kind == ir.FREQ_STATIC:
        return fixed_band(frequency_sql(rule), _or(rule.lower, 0.0), _or(rule.upper, 100.0))
    if kind in (ir.FREQ_DYNAMIC, ir.FREQ_HYBRID):
        bounds = g if kind == ir.FREQ_HYBRID else Guard(g.n, g.k, g.margin, g.margin_enabled, g.buffer)
        return sql_guard(frequency_sql(rule), bounds)
    if kind == ir.PERCENTILE:
        return sql_guard(f"select approx_percentile(cast({name} as double), {rule.values[0] if rule.values else '0.50'}) from primary", g)
    if kind == ir.UNIQUENESS:
        if not rule.values:
            raise ValueError("a uniqueness rule names its columns")
        parts = [f"cast({c.upper()} as {text_type})" for c in rule.values]
        key = parts[0] if len(parts) == 1 else "concat(" + ", '||', ".join(parts) + ")"
        return f'CustomSql "select cast(count(distinct {key}) as double) * 100.0 / count(*) from primary" >= 100.0'
    raise ValueError(f"{kind} has no text of its own")


#: What a metric is as SQL, for rules with a WHERE.
_AS_SQL = {ir.MEAN: "avg(cast({} as double))", ir.STDDEV: "stddev(cast({} as double))", ir.ROW_COUNT: "cast(count(*) as double)"}


def render_where(rule: Rule, where: str, text_type: str = "varchar") -> str | None:
    """The rule restricted by a condition, as CustomSql; None for keys, which concern the whole table."""
    kind, g = rule.rule_type, rule.guard
    name = rule.column.upper() if rule.column else ""
    sql = lambda what: f"select {what} from primary where {where}"
    if kind in _AS_SQL:
        guard = Guard(g.n, g.k, g.margin, g.margin_enabled, 0 if kind == ir.ROW_COUNT else g.buffer)
        return sql_guard(sql(_AS_SQL[kind].format(name)), guard)
    if kind == ir.COMPLETENESS:
        return f'CustomSql "{sql(f"cast(count({name}) as double) / nullif(count(*), 0)")}" >= {_or(rule.lower, 1.0):.2f}'
    if kind == ir.ALLOWED:
        listed = [v for v in rule.values if str(v).upper() != "NULL"]
        quoted = ", ".join("'" + str(v).replace("'", "''") + "'" for v in listed)
        return f'CustomSql "{sql(f"cast(count(case when cast({name} as {text_type}) not in ({quoted}) then 1 end) as double)")}" = 0'
    if kind == ir.DISTINCT:
        return f'CustomSql "{sql(f"cast(count(distinct {name}) as double)")}" = {int(_or(rule.lower, 0))}'
    if kind == ir.DISTINCT_RANGE:
        inner = sql(f"cast(count(distinct {name}) as double)")
        return f'(CustomSql "{inner}" >= {int(_or(rule.lower, 0))}) AND (CustomSql "{inner}" <= {int(_or(rule.upper, 999999))})'
    if kind == ir.FREQ_STATIC:
        return fixed_band(frequency_sql(rule, where), _or(rule.lower, 0.0), _or(rule.upper, 100.0))
    if kind in (ir.FREQ_DYNAMIC, ir.FREQ_HYBRID):
        return sql_guard(frequency_sql(rule, where), g)
    if kind == ir.PERCENTILE:
        return sql_guard(sql(f"approx_percentile(cast({name} as double), {rule.values[0] if rule.values else '0.50'})"), g)
    return None


#: Spark patterns by granularity.
DAY_PATTERNS = {"DAY": "yyyyMMdd", "MONTH": "yyyyMM", "YEAR": "yyyy"}


def date_condition(column: str, granularity: str, strategy: str = "CURRENT", lag: int = 0, is_integer: bool = False, pattern: str | None = None) -> str | None:
    """A condition on a date column relative to today: the current period, one some periods back, or the latest in the table."""
    if granularity == "NONE":
        return None
    if strategy == "MAX_VALUE":
        return f"{column} = (select max({column}) from primary)"
    day = "current_date()"
    if strategy == "LAG_N":
        day = f"date_sub(current_date(), {lag})" if granularity == "DAY" else f"add_months(current_date(), -{lag * (12 if granularity == 'YEAR' else 1)})"
    text = f"date_format({day}, '{pattern or DAY_PATTERNS[granularity]}')"
    return f"{column} = " + (f"cast({text} as int)" if is_integer else text)
