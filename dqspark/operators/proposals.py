"""Rule proposals as rows: bounds, backtest, score, tier, category, redundancy and order, by expressions over lookup tables.

A proposal has proposal_id, column_name, rule_type, metric_name, lower, upper, values, category_value, n, k, margin, margin_enabled,
the columns of a backtest summary (null total_periods: not backtested) and valid_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import filter_text
from ..rules import ir
from ..rules.ir import Guard, Rule
from ..rules.render import render, render_where
from ..sources.spec import DAILY, Grain
from . import backtest as BT
from . import history as H
from . import series as S

#: Weights of the score, and its lookup tables.
WEIGHTS = {"coverage": 0.30, "stability": 0.20, "interpretability": 0.10, "cost": 0.10, "regime": 0.15, "robustness": 0.15, "fp_risk": 0.10}
READABLE = {
    ir.MEAN: 1.0, ir.STDDEV: 1.0, ir.ROW_COUNT: 1.0, ir.COMPLETENESS: 1.0, ir.ALLOWED: 0.9, ir.DISTINCT: 0.9, ir.DISTINCT_RANGE: 0.9, ir.FREQ_STATIC: 0.8, ir.FREQ_DYNAMIC: 0.7, ir.FREQ_HYBRID: 0.7,
    ir.PERCENTILE: 0.8, ir.PRIMARY_KEY: 1.0, ir.UNIQUENESS: 0.8, ir.CUSTOM: 0.6,
}
CHEAP = {t: 0.6 if t == ir.CUSTOM else 0.7 if t in (ir.FREQ_STATIC, ir.FREQ_DYNAMIC, ir.FREQ_HYBRID, ir.PERCENTILE, ir.UNIQUENESS) else 1.0 for t in ir.RULE_TYPES}
FIT = {"STABLE": 1.0, "VOLATILE": 0.7, "TRENDING": 0.6, "SEASONAL": 0.7, "STRUCTURAL_BREAK": 0.4, "ZERO_INFLATED": 0.6, "ASYMMETRIC": 0.7, "SPARSE": 0.5}
FIT_BY_RULE = {
    ("VOLATILE", ir.ROW_COUNT): 0.9, ("VOLATILE", ir.COMPLETENESS): 0.9, ("VOLATILE", ir.MEAN): 0.6, ("VOLATILE", ir.STDDEV): 0.6,
    ("TRENDING", ir.MEAN): 0.5, ("TRENDING", ir.ROW_COUNT): 0.8, ("TRENDING", ir.COMPLETENESS): 0.9,
    ("STRUCTURAL_BREAK", ir.MEAN): 0.3, ("STRUCTURAL_BREAK", ir.STDDEV): 0.3, ("STRUCTURAL_BREAK", ir.ROW_COUNT): 0.5, ("STRUCTURAL_BREAK", ir.COMPLETENESS): 0.8,
    ("ZERO_INFLATED", ir.MEAN): 0.4, ("ZERO_INFLATED", ir.COMPLETENESS): 1.0, ("ZERO_INFLATED", ir.ROW_COUNT): 0.8,
    ("SPARSE", ir.COMPLETENESS): 0.9, ("ASYMMETRIC", ir.MEAN): 0.5,
}
SCORE_HIGH, SCORE_MEDIUM, TIER_SCORE, TIER_COVERAGE, TIER_FP = 0.80, 0.55, (0.70, 0.45), (80.0, 50.0), (2, 5)
RECOMMENDED, POSSIBLE, NOT_RECOMMENDED = "RECOMMENDED", "POSSIBLE", "NOT_RECOMMENDED"
MINIMAL_TYPES = (ir.ROW_COUNT, ir.PRIMARY_KEY, ir.COMPLETENESS, ir.ALLOWED, ir.MEAN)
RENDERED = "proposal_id string, rule string"


def _lookup(table: dict, key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in table.items() for x in ("|".join(k) if isinstance(k, tuple) else k, v)])[key], F.lit(default))


def regime_fit(rule_type: Column, regime: Column, others: Column) -> Column:
    """How well a rule suits a regime; each secondary regime takes 30 % of what it lacks."""
    def fit(r: Column) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for k, v in FIT_BY_RULE.items() for x in ("|".join(k), v)])[F.concat_ws("|", r, rule_type)], _lookup(FIT, r, 0.8))

    less = F.aggregate(F.coalesce(others, F.array().cast("array<string>")), fit(regime), lambda acc, r: F.greatest(F.lit(0.0), acc - (1 - fit(r)) * 0.30))
    return F.when(regime.isNull(), 1.0).otherwise(F.round(less, 4))


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _part(dimension: str, value: Column) -> Column:
    """A weighted dimension of few digits, as the double nearest to the exact product: sums then end alike on both engines."""
    return F.round(WEIGHTS[dimension] * value, 9)


def _metric(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def scored(p: DataFrame, tiers=DAILY.robustness) -> DataFrame:
    """Adds the dimensions, score_total and confidence. Columns of a series profile, where p has them, are taken into account."""
    tested, kind = F.col("total_periods").isNotNull(), F.col("rule_type")
    regime = F.col("regime") if "regime" in p.columns else F.lit(None).cast("string")
    others = F.col("secondary_regimes") if "secondary_regimes" in p.columns else F.lit(None).cast("array<string>")
    cv, nulls, outliers = _metric(p, "cv"), _metric(p, "null_pct"), _metric(p, "n_outliers_iqr")
    fp = F.col("false_positive_proxy")
    risk = F.least(fp * 0.10, F.lit(0.40)) + F.when(F.col("band_width_ratio") < 0.10, 0.15).otherwise(0.0) + F.when(cv > 0.50, 0.20).when(cv > 0.30, 0.10).otherwise(0.0)
    risk = F.least(F.round(risk + F.when(_flag(p, "is_asymmetric"), 0.15).otherwise(0.0) + F.when(outliers > 3, 0.10).otherwise(0.0), 4), F.lit(1.0))
    few = F.lit(0.0)
    for limit, penalty in sorted(tiers, reverse=True):
        few = F.when(F.col("valid_count") < limit, penalty).otherwise(few)
    robust = 1 + few - F.when(nulls > 50, 0.25).when(nulls > 30, 0.15).when(nulls > 10, 0.05).otherwise(0.0) - F.when(_flag(p, "is_zero_inflated"), 0.10).otherwise(0.0) - F.when(outliers > 5, 0.10).otherwise(0.0)
    out = p.withColumns({
        "interpretability": _lookup(READABLE, kind, 0.5), "cost_efficiency": _lookup(CHEAP, kind, 0.5), "regime_fit": regime_fit(kind, regime, others),
        "fp_risk": F.when(tested, risk).otherwise(F.lit(0.0)), "robustness": F.greatest(F.round(robust, 4), F.lit(0.0)),
    })
    total = WEIGHTS["coverage"] * F.col("coverage_pct") / 100 + _part("stability", F.col("stability_score")) + _part("interpretability", F.col("interpretability")) + _part("cost", F.col("cost_efficiency"))
    total = total + _part("regime", F.col("regime_fit")) + _part("robustness", F.col("robustness")) - _part("fp_risk", F.col("fp_risk"))
    total = F.when(tested, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).otherwise(F.lit(0.0))
    total = F.round(total * 10000) / 10000  # before levels: a sum of 0.8 may come out an ulp below; halves go by the scaled sum, as they do in SQL
    level = F.when(~tested | (F.col("valid_count") < 3), "LOW").when(total >= SCORE_HIGH, "HIGH").when(total >= SCORE_MEDIUM, "MEDIUM").otherwise("LOW")
    return out.withColumns({"score_total": total, "confidence": level})


def estimated_score() -> Column:
    """The score without a profile, which tiers go by."""
    w = WEIGHTS
    s = w["coverage"] * F.col("coverage_pct") / 100 + w["stability"] * F.col("stability_score") + w["interpretability"] * _lookup(READABLE, F.col("rule_type"), 0.5) + w["cost"] * _lookup(CHEAP, F.col("rule_type"), 0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s + w["regime"] + w["robustness"]))


def tiered(p: DataFrame, grain: Grain = DAILY) -> DataFrame:
    """Adds tier, reasons, priority_score and category."""
    tested, kind, cover, fp = F.col("total_periods").isNotNull(), F.col("rule_type"), F.col("coverage_pct"), F.col("false_positive_proxy")
    regime = F.col("regime") if "regime" in p.columns else F.lit(None).cast("string")
    others = F.col("secondary_regimes") if "secondary_regimes" in p.columns else F.lit(None).cast("array<string>")
    trivial = (kind == ir.COMPLETENESS) & (F.coalesce("lower", F.lit(1.0)) >= 1.0) & tested & (cover >= 100) & (fp == 0)
    levels = kind.isin(ir.MEAN, ir.STDDEV)
    hostile = F.coalesce(levels & (regime == "STRUCTURAL_BREAK"), F.lit(False))
    wary = F.coalesce(levels & (regime.isin("SPARSE", "ZERO_INFLATED", "VOLATILE") | F.coalesce(F.array_contains(others, "STRUCTURAL_BREAK"), F.lit(False))), F.lit(False))
    dynamic, score = kind.isin(*ir.DYNAMIC_TYPES), estimated_score()
    short, little = dynamic & (F.col("total_periods") < grain.dynamic_periods), dynamic & (F.col("total_periods") < grain.possible_periods)
    never = [(trivial, "trivial completeness"), (hostile, "regime contradicts the baseline"), (~tested, "no backtest"), (little, "too little history"), (cover < TIER_COVERAGE[1], "insufficient coverage"), (fp > TIER_FP[1], "many false positives"), (score < TIER_SCORE[1], "very low score")]
    maybe = [(short, "limited history"), (cover < TIER_COVERAGE[0], "moderate coverage"), (fp > TIER_FP[0], "some false positives"), (score < TIER_SCORE[0], "moderate score"), (wary, "regime calls for caution")]
    reason = F.lit(None).cast("string")
    for condition, text in reversed(never):
        reason = F.when(F.coalesce(condition, F.lit(False)), text).otherwise(reason)
    soft = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in maybe]), lambda x: x.isNotNull())
    tier = F.when(reason.isNotNull(), NOT_RECOMMENDED).when(F.size(soft) > 0, POSSIBLE).otherwise(RECOMMENDED)
    weighted = F.col("weighted_coverage_pct")
    bonus = F.when(weighted > 0, F.greatest(F.lit(0.0), F.least(F.lit(0.05), (weighted - cover) / 100 * 0.5))).otherwise(F.lit(0.0))
    priority = F.when(tested, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score + bonus - F.least(F.lit(0.10), fp * 0.02), 4)))).otherwise(F.lit(0.0))
    out = p.withColumns({"tier": tier, "reasons": F.when(reason.isNotNull(), F.array(reason)).otherwise(soft), "priority_score": priority})
    return out.withColumn("category", category())


def category() -> Column:
    return F.when(F.col("tier") == NOT_RECOMMENDED, NOT_RECOMMENDED).when(F.col("tier") == POSSIBLE, "NEEDS_REVIEW").when(F.col("rule_type").isin(*ir.SIMPLE_TYPES), "CONSERVATIVE").otherwise("STRONG")


def without_redundancy(p: DataFrame) -> DataFrame:
    """Demotes rules that another of the column covers: exact distinct counts by allowed values, full completeness by a key, the median by the mean."""
    w = Window.partitionBy("column_name")
    listed = F.max(F.when(F.col("rule_type") == ir.ALLOWED, 1)).over(w).isNotNull()
    has_mean = F.max(F.when(F.col("rule_type") == ir.MEAN, 1)).over(w).isNotNull()
    keys = p.where(F.col("rule_type") == ir.PRIMARY_KEY).select(F.explode("values").alias("_key")).distinct()
    q = p.join(keys, F.col("column_name") == F.col("_key"), "left")
    middle = F.coalesce(F.abs(F.try_element_at("values", F.lit(1)).try_cast("double") - 0.50) < 0.01, F.lit(False)) | F.lower("metric_name").contains("p50")
    by = (
        F.when((F.col("rule_type") == ir.DISTINCT) & listed, "AllowedValues")
        .when((F.col("rule_type") == ir.COMPLETENESS) & F.col("_key").isNotNull() & (F.coalesce("lower", F.lit(1.0)) >= 1.0), "IsPrimaryKey")
        .when((F.col("rule_type") == ir.PERCENTILE) & has_mean & middle, "Mean")
    )
    q = q.withColumn("covered_by", by).drop("_key")
    q = q.withColumn("tier", F.when(F.col("covered_by").isNotNull(), NOT_RECOMMENDED).otherwise(F.col("tier")))
    q = q.withColumn("reasons", F.when(F.col("covered_by").isNotNull(), F.concat("reasons", F.array(F.concat(F.lit("redundant with "), "covered_by")))).otherwise(F.col("reasons")))
    return q.withColumn("category", category())


def prioritised(p: DataFrame) -> DataFrame:
    """Adds position from 1: tier, priority, coverage, fewest false positives, then id."""
    rank = F.when(F.col("tier") == RECOMMENDED, 2).when(F.col("tier") == POSSIBLE, 1).otherwise(0)
    order = [rank.desc(), F.col("priority_score").desc(), F.coalesce("coverage_pct", F.lit(0.0)).desc(), F.coalesce("false_positive_proxy", F.lit(999)).asc(), F.col("proposal_id").asc()]
    return p.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # proposals of one table: hundreds of rows


def recommended(p: DataFrame, grain: Grain = DAILY) -> DataFrame:
    """Score, tier, redundancy, order."""
    return prioritised(without_redundancy(tiered(scored(p, grain.robustness), grain)))


def minimal_set(p: DataFrame) -> DataFrame:
    return p.where(F.col("rule_type").isin(*MINIMAL_TYPES) & (F.col("tier") == RECOMMENDED) & F.col("category").isin("STRONG", "CONSERVATIVE"))


DIMENSIONS = ("coverage", "stability_score", "interpretability", "cost_efficiency", "regime_fit", "robustness")


def compared(p: DataFrame, a: str, b: str) -> DataFrame:
    """Which of two scored proposals wins, by two points of score, and where each leads by five."""
    one = lambda i, x: p.where(F.col("proposal_id") == i).select(*[F.col(c).alias(f"{x}_{c}") for c in ("proposal_id", "score_total", "fp_risk", *DIMENSIONS[1:])], (F.col("coverage_pct") / 100).alias(f"{x}_coverage"))
    both = one(a, "a").crossJoin(one(b, "b"))  # one row each
    gap = F.round(F.col("a_score_total") - F.col("b_score_total"), 9)
    lead = lambda x, y: F.filter(F.array(*[F.when(F.col(f"{x}_{d}") - F.col(f"{y}_{d}") >= 0.05 - 1e-9, d) for d in DIMENSIONS], F.when(F.col(f"{y}_fp_risk") - F.col(f"{x}_fp_risk") >= 0.05 - 1e-9, "fp_risk")), lambda v: v.isNotNull())
    return both.select(F.col("a_proposal_id").alias("a"), F.col("b_proposal_id").alias("b"), F.when(F.abs(gap) < 0.02, "tie").when(gap > 0, "A").otherwise("B").alias("winner"), F.col("a_score_total").alias("score_a"), F.col("b_score_total").alias("score_b"), lead("a", "b").alias("advantages_a"), lead("b", "a").alias("advantages_b"))


# making proposals


BASE = ("proposal_id", "column_name", "rule_type", "metric_name", "lower", "upper", "values", "category_value", "n", "k", "margin", "margin_enabled", "valid_count")


def _shape(rows: DataFrame, rule_type: Column, column: Column, metric: Column, guard: Guard, lower: Column, upper: Column, values: Column | None = None, category_value: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    keep = [c for c in rows.columns if c in ("total_periods", "periods_pass", "periods_fail", "coverage_pct", "weighted_coverage_pct", "false_positive_proxy", "band_width_ratio", "stability_score", "has_drift", "outlier_periods", "valid_count")]
    pid = F.substring(F.sha2(F.concat_ws("|", column, rule_type, metric, F.coalesce(category_value if category_value is not None else none, F.lit(""))), 256), 1, 16)
    return rows.select(pid.alias("proposal_id"), column.alias("column_name"), rule_type.alias("rule_type"), metric.alias("metric_name"), lower.cast("double").alias("lower"), upper.cast("double").alias("upper"), (values if values is not None else F.array().cast("array<string>")).alias("values"),
                       (category_value if category_value is not None else none).alias("category_value"), F.lit(guard.n).alias("n"), F.lit(float(guard.k)).alias("k"), F.lit(float(guard.margin)).alias("margin"), F.lit(guard.margin_enabled).alias("margin_enabled"), *keep)


def _counted(s: DataFrame) -> DataFrame:
    return s.groupBy("series_id").agg(F.count("value").alias("valid_count"))


def guarded(s: DataFrame, guard: Guard, rule_type: Column, column: Column, metric: Column, grain: Grain = DAILY, break_aware: bool = True, values: Column | None = None) -> DataFrame:
    """Dual-guard proposals of all series: bounds from after a break, the union of both bands, backtested over all points."""
    s = S.held(s)  # bands, backtest and detectors read it; a row per period
    recent = S.after_change(s, S.change_points(s)) if break_aware else s
    bands = S.sigma_band(recent, guard.n, guard.k).select("series_id", F.col("lower").alias("sl"), F.col("upper").alias("su"))
    bands = bands.join(S.margin_band(recent, guard.n, guard.margin).select("series_id", F.col("lower").alias("ml"), F.col("upper").alias("mu")), "series_id")
    summary = BT.dual_guard_summary(s, guard.n, guard.k, guard.margin, grain.min_history, guard.margin_enabled)
    rows = bands.join(summary, "series_id").join(_counted(s), "series_id")
    lower, upper = (F.least("sl", "ml"), F.greatest("su", "mu")) if guard.margin_enabled else (F.col("sl"), F.col("su"))
    return _shape(rows, rule_type, column, metric, guard, lower, upper, values)


def numeric(histories: DataFrame, guard: Guard = Guard(), grain: Grain = DAILY) -> DataFrame:
    """Mean, deviation and completeness of every column at once; histories has column_name beside a numeric history."""
    pairs = F.explode(F.array(*[F.struct(F.concat_ws(":", "column_name", F.lit(m)).alias("series_id"), F.col(m).alias("value")) for m in ("mean", "stddev")]))
    s = S.series(histories.select("period", pairs.alias("x")).select("period", "x.series_id", "x.value"), "value", "series_id")
    column, metric = F.substring_index("series_id", ":", 1), F.substring_index("series_id", ":", -1)
    bands = guarded(s, guard, F.when(metric == "mean", ir.MEAN).otherwise(ir.STDDEV), column, metric, grain)
    return bands.unionByName(completeness(histories, guard))


def completeness(histories: DataFrame, guard: Guard = Guard(), at_least: float = 0.90) -> DataFrame:
    """Completeness of the columns that are nearly full, at the observed ratio."""
    ratio = histories.groupBy("column_name").agg((F.sum("non_null_count") / F.sum("total_count")).alias("r")).where(F.col("r") >= at_least).select("column_name", F.bround("r", 2).alias("t"))
    rows = histories.where("total_count > 0").join(ratio, "column_name")
    pct = F.bround(F.col("non_null_count") / F.col("total_count") * 100, 2)
    s = S.series(rows.withColumn("x", pct), "x", "column_name").join(ratio.withColumnRenamed("column_name", "series_id"), "series_id")
    p = BT._pointwise(s, F.col("value") >= F.col("t") * 100 - S.EPS, F.abs(F.col("value") - F.col("t") * 100) <= 2, s, weighted=True).join(_counted(s), "series_id").join(ratio.withColumnRenamed("column_name", "series_id"), "series_id")
    return _shape(p, F.lit(ir.COMPLETENESS), F.col("series_id"), F.lit("completeness"), guard, F.col("t"), F.lit(None))


def row_count(history: DataFrame, guard: Guard = Guard(), grain: Grain = DAILY) -> DataFrame:
    s = S.series(history, "row_count", F.lit("rows"))
    return guarded(s, guard, F.lit(ir.ROW_COUNT), F.lit(None).cast("string"), F.lit("row_count"), grain, break_aware=False)


def percentiles(histories: DataFrame, names=("p10", "p90"), guard: Guard = Guard(), grain: Grain = DAILY) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.concat_ws(":", "column_name", F.lit(m)).alias("series_id"), F.col(m).alias("value")) for m in names]))
    s = S.series(histories.select("period", pairs.alias("x")).select("period", "x.series_id", "x.value"), "value", "series_id")
    metric = F.substring_index("series_id", ":", -1)
    fraction = F.format_string("%.2f", F.substring(metric, 2, 2).cast("double") / 100)
    return guarded(s, guard, F.lit(ir.PERCENTILE), F.substring_index("series_id", ":", 1), metric, grain, break_aware=False, values=F.array(fraction))


def frequencies(dist: DataFrame, column: str, top: list[str], guard: Guard = Guard(), grain: Grain = DAILY, mode: str = "static", floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """Share of each of the top values: a static band in points, the dynamic guard, or the guard with a floor and ceiling."""
    s = S.series(dist.where(F.col("category_value").isin(*top)), "value_pct", "category_value")
    pp = guard.margin * 100
    if mode == "static":
        points, kind = BT.frequency_band(s, guard.n, pp, guard.k, grain.min_history), ir.FREQ_STATIC
    else:
        kind = ir.FREQ_DYNAMIC if mode == "dynamic" else ir.FREQ_HYBRID
        points = BT.frequency_dual_guard(s, guard.n, guard.k, guard.margin, guard.buffer, grain.min_history, guard.margin_enabled, *((floor, ceiling) if mode == "hybrid" else (None, None)))
    band = S.frequency_band(s, guard.n, pp, guard.k).select("series_id", F.bround("lower", 2).alias("lo"), F.bround("upper", 2).alias("hi"))
    rows = band.join(BT.frequency_summary(s, points, guard.n, guard.k, pp, grain.min_history), "series_id").join(_counted(s), "series_id")
    return _shape(rows, F.lit(kind), F.lit(column), F.concat(F.lit("cat_freq_"), "series_id"), guard, F.col("lo"), F.col("hi"), None, F.col("series_id"))


def categorical(df: DataFrame, column: str, semantic_type: str, null_ratio: float, guard: Guard = Guard(), grain: Grain = DAILY, mode: str = "static", max_values: int = 5, **bounds) -> DataFrame:
    """Allowed values, distinct counts, frequencies of the top values and completeness of one categorical column; df has a period.

    The whole domain of a low cardinality column becomes part of the rules' text; that of another is counted in Spark, and
    only its top values are fetched.
    """
    values = H.domain(df, column).where(F.col("category_value").isNotNull())
    counts = H.distinct_counts(df, column, exact=True)
    s = S.series(counts, "distinct_count", F.lit(column))
    low, mid, parts = semantic_type == "CATEGORICAL_LOW", semantic_type == "CATEGORICAL_MID", []
    domain = [r["category_value"] for r in (values if low else values.limit(max_values)).collect()] if low or mid else []
    if low:
        seen = BT.allowed_values(H.observed_values(df, column), domain, column).withColumn("valid_count", F.col("total_periods"))
        parts.append(_shape(seen, F.lit(ir.ALLOWED), F.lit(column), F.lit("allowed_values"), guard, F.lit(None), F.lit(None), F.array(*map(F.lit, domain))))
        exact = BT.distinct_exact(s, len(domain)).join(_counted(s), "series_id")
        parts.append(_shape(exact, F.lit(ir.DISTINCT), F.lit(column), F.lit("distinct_count"), guard, F.lit(len(domain)), F.lit(None)))
    elif mid:
        size = values.count()
        slack = max(int(size * 0.10), 2)
        lo, hi = max(1, size - slack), size + slack
        parts.append(_shape(BT.distinct_range(s, lo, hi).join(_counted(s), "series_id"), F.lit(ir.DISTINCT_RANGE), F.lit(column), F.lit("distinct_count_range"), guard, F.lit(lo), F.lit(hi)))
    if (low or mid) and domain:
        parts.append(frequencies(H.distribution(df, column), column, domain[:max_values], guard, grain, mode, **bounds))
    if null_ratio <= 0.10:
        parts.append(completeness(counts.withColumn("column_name", F.lit(column)), guard, 0.0))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def primary_key(history: DataFrame, keys: list[str], guard: Guard = Guard()) -> DataFrame:
    """A key rule if there are no duplicates: IsPrimaryKey, or uniqueness with completeness of the columns that have nulls.

    With duplicates the key rule is there, but is marked as a warning by `has_duplicates`.
    """
    bt = BT.primary_key(history, keys).withColumn("valid_count", F.col("total_periods"))
    nulls = [F.sum(F.col("total_rows") - F.col(f"non_null_{k}")).alias(f"_n_{k}") for k in keys]
    state = history.agg(F.sum("duplicate_count").alias("_d"), F.sum("total_rows").alias("_t"), *nulls)
    rows = bt.crossJoin(F.broadcast(state))  # one row
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | (F.col(f"_n_{k}") > 0)
    kind = F.when((F.col("_d") == 0) & some_null, ir.UNIQUENESS).otherwise(ir.PRIMARY_KEY)
    key = _shape(rows, kind, F.lit(None).cast("string"), F.lower(kind), guard, F.lit(None), F.lit(None), F.array(*map(F.lit, keys)))
    out = key.crossJoin(F.broadcast(state.select((F.col("_d") > 0).alias("has_duplicates"))))
    for k in keys:
        ratio = F.bround((F.col("_t") - F.col(f"_n_{k}")) / F.col("_t"), 2)
        part = state.where((F.col("_d") == 0) & (F.col(f"_n_{k}") > 0)).withColumn("valid_count", F.lit(0).cast("long"))
        out = out.unionByName(_shape(part, F.lit(ir.COMPLETENESS), F.lit(k), F.lit("completeness"), guard, ratio, F.lit(None)).withColumn("has_duplicates", F.lit(False)), allowMissingColumns=True)
    return out


def rule_of(row) -> Rule:
    """The rule of a collected proposal."""
    g = Guard(row["n"] or 30, row["k"] if row["k"] is not None else 2.0, row["margin"] if row["margin"] is not None else 0.10, bool(row["margin_enabled"]))
    return Rule(row["rule_type"], row["column_name"], g, row["lower"], row["upper"], tuple(row["values"] or ()), row["category_value"])


def texts(p: DataFrame) -> DataFrame:
    """proposal_id, rule: text is rendered on the driver, where numbers are written as Python writes them; proposals are few."""
    rows = [(r["proposal_id"], render(rule_of(r))) for r in p.select(*BASE[:-1]).collect()]
    return p.sparkSession.createDataFrame(rows, RENDERED)


def robust_choice(s: DataFrame, n: int, k: float = 2.0) -> DataFrame:
    """series_id, choice: classical bands, or quartiles or deviations from the median where outliers distort the classical one."""
    width = lambda b, c: b.select("series_id", (F.col("upper") - F.col("lower")).alias(c))
    rows = width(S.sigma_band(s, n, k), "sw").join(width(S.iqr_band(s, n), "iw"), "series_id").join(S.outliers(s, n=n).groupBy("series_id").agg(F.count("*").alias("o")), "series_id", "left")
    ratio = F.when((F.col("sw") > 0) & (F.col("iw") > 0), F.col("sw") / F.col("iw"))
    return rows.select("series_id", F.coalesce(F.when((ratio > 2) & (F.coalesce("o", F.lit(0)) >= 2), "robust_iqr").when(ratio > 3, "robust_mad"), F.lit("classical")).alias("choice"))


def recalculated(histories: DataFrame, old: DataFrame, guard: Guard, grain: Grain = DAILY, rows: DataFrame | None = None, dist: DataFrame | None = None, bounds: tuple = (None, None)) -> DataFrame:
    """The same proposals under other parameters: banded, backtested, scored and ordered anew; what has no parameters stays as it is.

    `rows` is the history of row counts and `dist` a distribution(period, category_value, value_pct); rules of these stay if it isn't there.
    """
    made = [numeric(histories, guard, grain)]
    names = [f"p{q:02d}" for q in range(100) if f"p{q:02d}" in histories.columns]
    if names:
        made.append(percentiles(histories, tuple(names), guard, grain))
    if rows is not None:
        made.append(row_count(rows, guard, grain))
    if dist is not None:
        top = [r["category_value"] for r in old.where(F.col("rule_type").isin(ir.FREQ_DYNAMIC, ir.FREQ_HYBRID)).select("category_value", "column_name").distinct().collect()]  # a proposal each
        for r in old.where(F.col("rule_type").isin(ir.FREQ_DYNAMIC, ir.FREQ_HYBRID)).select("rule_type", "column_name").distinct().collect():
            mode = "dynamic" if r["rule_type"] == ir.FREQ_DYNAMIC else "hybrid"
            made.append(frequencies(dist, r["column_name"], top, guard, grain, mode, *bounds))
    new = made[0]
    for p in made[1:]:
        new = new.unionByName(p, allowMissingColumns=True)
    new = new.join(old.where(F.col("rule_type") != ir.FREQ_STATIC).select("proposal_id"), "proposal_id", "left_semi")
    stay = old.select(*[c for c in old.columns if c in new.columns]).join(new.select("proposal_id"), "proposal_id", "left_anti")
    return recommended(new.unionByName(stay, allowMissingColumns=True), grain)


def calibrated(histories: DataFrame, calibration: DataFrame, known: DataFrame | None = None, grain: Grain = DAILY, least: str = "HIGH") -> DataFrame:
    """Mean and deviation proposals of all columns under their own calibrated parameters, where confidence is enough and there is no such rule yet.

    calibration has a row per column: series_id is its name. Columns with equal parameters share one plan.
    """
    enough = ("HIGH",) if least == "HIGH" else ("HIGH", "MEDIUM")
    good = calibration.where(F.col("confidence").isin(*enough))
    out = None
    settings = good.groupBy("n", "sigma", "margin_pct", "margin_enabled").agg(F.collect_list("series_id").alias("columns")).collect()  # at most a column each
    for r in settings:
        guard = Guard(r["n"], r["sigma"], r["margin_pct"], r["margin_enabled"])
        p = numeric(histories.where(F.col("column_name").isin(r["columns"])), guard, grain).where(F.col("rule_type").isin(ir.MEAN, ir.STDDEV))
        out = p if out is None else out.unionByName(p)
    if out is None:
        return numeric(histories.limit(0), Guard(), grain)
    return out if known is None else out.join(known.select("rule_type", "column_name"), ["rule_type", "column_name"], "left_anti")


def subpopulation(df: DataFrame, column: str, condition: str, guard: Guard = Guard(), grain: Grain = DAILY) -> DataFrame:
    """Numeric proposals of the rows that meet a condition; their rules are rendered with it (see `where_texts`)."""
    rows = df.where(F.expr(filter_text(condition)))
    return numeric(H.numeric(rows, column).withColumn("column_name", F.lit(column)), guard, grain)


def where_texts(p: DataFrame, condition: str) -> DataFrame:
    """proposal_id, rule: the rules restricted by a condition; whole-table rules keep their plain text."""
    rows = []
    for r in p.select(*BASE[:-1]).collect():
        rule = rule_of(r)
        rows.append((r["proposal_id"], render_where(rule, condition) or render(rule)))
    return p.sparkSession.createDataFrame(rows, RENDERED)
