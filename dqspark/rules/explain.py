"""Rules, regimes, calibrations and results in words."""

from __future__ import annotations

from . import ir
from .ir import Rule

_WHAT = {
    ir.MEAN: "the mean of {c}", ir.STDDEV: "the standard deviation of {c}", ir.ROW_COUNT: "the number of rows", ir.COMPLETENESS: "the share of filled values of {c}", ir.ALLOWED: "the values of {c}", ir.DISTINCT: "the number of distinct values of {c}",
    ir.DISTINCT_RANGE: "the number of distinct values of {c}", ir.FREQ_STATIC: "the share of {v} in {c}", ir.FREQ_DYNAMIC: "the share of {v} in {c}", ir.FREQ_HYBRID: "the share of {v} in {c}", ir.PERCENTILE: "quantile {q} of {c}", ir.PRIMARY_KEY: "the key ({k})", ir.UNIQUENESS: "the key ({k})", ir.CUSTOM: "a query's result",
}
#: What each regime means for bands.
REGIMES = {
    "STABLE": "values vary little around one level; standard bands suit", "VOLATILE": "values vary widely; narrow bands raise false alarms", "TRENDING": "values drift; short windows keep up with them", "SEASONAL": "values follow the weekday; windows of whole weeks even that out",
    "STRUCTURAL_BREAK": "the level has changed; only periods since then are a baseline", "ZERO_INFLATED": "many zeros distort the mean; watch completeness and volume", "ASYMMETRIC": "one tail is longer; symmetric bands alert on one side", "SPARSE": "many periods have no value; statistics rest on few points",
}


def number(x: float | None) -> str:
    if x is None:
        return "-"
    return f"{x:,.0f}" if x == int(x) and abs(x) < 1e15 else f"{x:,.2f}" if abs(x) >= 1 else f"{x:.6g}"


def subject(rule: Rule) -> str:
    return _WHAT[rule.rule_type].format(c=rule.column or "the table", v=rule.category, q=rule.values[0] if rule.values else "0.50", k=", ".join(rule.values))


def rule(r: Rule) -> str:
    """What a rule checks."""
    g, what = r.guard, subject(r)
    if r.rule_type in ir.DYNAMIC_TYPES:
        text = f"{what} stays within {number(g.k)} standard deviations of its mean over the last {g.n} runs"
        text += f", or within {g.margin:.0%} of it" if g.margin_enabled else ""
        return text + (f", and between {number(g.floor)} and {number(g.ceiling)}" if r.rule_type == ir.FREQ_HYBRID and (g.floor > 0 or g.ceiling < 100) else "")
    if r.rule_type == ir.COMPLETENESS:
        return f"{what} is at least {1.0 if r.lower is None else r.lower:.0%}"
    if r.rule_type == ir.ALLOWED:
        return f"{what} are among {len(r.values)} known ones"
    if r.rule_type == ir.DISTINCT:
        return f"{what} is {number(r.lower)}"
    if r.rule_type in (ir.DISTINCT_RANGE, ir.FREQ_STATIC):
        return f"{what} is between {number(r.lower)} and {number(r.upper)}"
    if r.rule_type in (ir.PRIMARY_KEY, ir.UNIQUENESS):
        return f"{what} names every row once" + (" and has no nulls" if r.rule_type == ir.PRIMARY_KEY else "")
    return what


def trade_offs(r: Rule) -> list[str]:
    """What changing the parameters of a dynamic rule does."""
    if r.rule_type not in ir.DYNAMIC_TYPES:
        return []
    out = ["a larger sigma misses more and alerts less" if r.guard.k <= 2 else "a smaller sigma alerts earlier and more often", "a longer window is steadier, a shorter one follows changes sooner"]
    return out + (["the margin keeps bands of very steady series from being too narrow"] if r.guard.margin_enabled else ["without a margin, very steady series get very narrow bands"])


def regime(profile: dict) -> list[str]:
    """What a series profile says, main regime first."""
    return [REGIMES[x] for x in (profile["regime"], *(profile.get("secondary_regimes") or ()))]


def calibration(row: dict) -> str:
    """The report of a calibrated series."""
    margin = f"margin {row['margin_pct']:.0%}" if row["margin_enabled"] else "no margin"
    end = "usable" if row["viable"] else "too unsteady for an automatic rule"
    return f"N={row['n']}, sigma {row['sigma']:g}, {margin}: {row['coverage_pct']:.1f} % of periods, {row['false_positives']} false positives, {row['recent_fails']} recent failures; {end}"


def result(row: dict) -> str:
    """A rule's outcome with the values and bounds it rests on."""
    values = ", ".join(f"{k} = {number(v)}" for k, v in sorted((row.get("metrics") or {}).items()))
    low, high = row.get("lower_bound", row.get("compiled_lower")), row.get("upper_bound", row.get("compiled_upper"))
    bounds = f"; expected {number(low)} to {number(high)}" if low is not None or high is not None else ""
    reason = f"; {row['failure_reason']}" if row.get("failure_reason") else ""
    return f"{row['outcome']}: {values or 'no metric'}{bounds}{reason}"


def date_condition(granularity: str, strategy: str = "CURRENT", lag: int = 0) -> str:
    if granularity == "NONE":
        return "the whole table is checked"
    unit = granularity.lower()
    if strategy == "MAX_VALUE":
        return f"only the latest {unit} in the table is checked"
    if strategy == "LAG_N" and lag:
        return f"only the {unit} {lag} before the current one is checked"
    return f"only the current {unit} is checked; a job that runs more often than data arrive sees the same rows again, and its past runs have no spread"


def history_gap(periods: int, min_history: int) -> str | None:
    """Why there is too little to analyse, if so."""
    if periods == 0:
        return "no period in the window: check the reference day, the filters and the date format"
    if periods < min_history:
        return f"{periods} periods, {min_history} are needed: look back further"
    return None
