"""Backtests: every series and parameter tuple in one windowed plan, then conditional aggregates.

Points are (series_id, idx, period, value, center, lower, upper, ..., passed); a summary is one row per series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import drift, frame, last, monotonic_trend, rolling_bands, valid, within

RECENCY, BUFFER = 0.05, 0.01


def _enough(s: DataFrame, min_history: int) -> DataFrame:
    """Series with that many valid points; others aren't evaluated."""
    return s.withColumn("_nv", F.count("value").over(Window.partitionBy("series_id"))).where(F.col("_nv") >= min_history).drop("_nv")


def dual_guard(s: DataFrame, n: int, k: float = 2.0, margin: float = 0.10, min_history: int = 7, margin_enabled: bool = True, as_rendered: bool = False) -> DataFrame:
    """Points that lie in the sigma band or, if enabled, in the margin band of the n rows before.

    As rendered, both bands get the rule text's buffer, and the margin follows the mean's sign.
    """
    b = rolling_bands(_enough(s, min_history), n, k, margin, min_history).where(F.col("value").isNotNull() & F.col("center").isNotNull())
    if as_rendered:
        b = b.withColumns({"lower": F.col("lower") - BUFFER, "upper": F.col("upper") + BUFFER, "margin_lower": F.col("center") * (1 - margin) - BUFFER, "margin_upper": F.col("center") * (1 + margin) + BUFFER})
    in_sigma = within(F.col("value"), F.col("lower"), F.col("upper"))
    in_margin = within(F.col("value"), F.col("margin_lower"), F.col("margin_upper")) if margin_enabled else F.lit(False)
    return b.withColumn("passed", in_sigma | in_margin)


def frequency_band(s: DataFrame, n: int, margin_pp: float, k: float, min_history: int = 7) -> DataFrame:
    """Percentages against the clamped band of the n rows before."""
    b = rolling_bands(_enough(s, min_history), n, k, 0.0, min_history).where(F.col("value").isNotNull() & F.col("center").isNotNull())
    b = b.withColumns({"lower": F.greatest(F.col("lower") - margin_pp, F.lit(-0.01)), "upper": F.least(F.col("upper") + margin_pp, F.lit(100.01))})
    return b.withColumn("passed", within(F.col("value"), F.col("lower"), F.col("upper")))


def frequency_dual_guard(s: DataFrame, n: int, k: float = 2.0, margin: float = 0.10, buffer: float = BUFFER, min_history: int = 7, margin_enabled: bool = True, floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """Sigma or margin band with a buffer; hybrid if a floor or ceiling is given, which must hold too."""
    b = rolling_bands(_enough(s, min_history), n, k, 0.0, min_history).where(F.col("value").isNotNull() & F.col("center").isNotNull())
    b = b.withColumns({"lower": F.col("lower") - buffer, "upper": F.col("upper") + buffer, "margin_lower": F.col("center") * (1 - margin) - buffer, "margin_upper": F.col("center") * (1 + margin) + buffer})
    passed = within(F.col("value"), F.col("lower"), F.col("upper"))
    if margin_enabled:
        passed |= within(F.col("value"), F.col("margin_lower"), F.col("margin_upper"))
    if floor is not None or ceiling is not None:
        passed &= F.col("value").between(0.0 if floor is None else floor, 100.0 if ceiling is None else ceiling)
    return b.withColumn("passed", passed)


def weighted_coverage(points: DataFrame) -> DataFrame:
    """Share of passed points, the newest weighing most."""
    age = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("idx").desc())) - 1
    g = points.withColumn("w", F.exp(-RECENCY * age)).groupBy("series_id").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("passed"), F.col("w")).otherwise(0.0)).alias("p"))
    return g.select("series_id", F.round(F.col("p") / F.col("t") * 100, 2).alias("weighted_coverage_pct"))


def stability(s: DataFrame, n: int, k: float, min_history: int = 7, margin_pp: float | None = None) -> DataFrame:
    """How much the band of the last n points moves for n - 2 and n + 2; percentages if a margin in points is given."""
    return stabilities(s, (n,), (k,), min_history, margin_pp).select("series_id", "stability_score")


def stabilities(s: DataFrame, ns, sigmas, min_history: int = 7, margin_pp: float | None = None) -> DataFrame:
    """series_id, n, k, stability_score for all sizes and sigmas: moments of all sizes in one aggregate, sigmas by arithmetic."""
    # as SQL text: some hundreds of small expressions, which cost seconds as so many calls into the JVM
    nearby = {n: (n, max(min_history, n - 2), max(min_history, n + 2)) for n in ns}
    rows = valid(s).withColumn("rn", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("idx").desc())))
    sizes = sorted({x for near in nearby.values() for x in near})
    moments = {"m": "avg(value) FILTER (WHERE rn <= {0})", "s": "coalesce(stddev_samp(value) FILTER (WHERE rn <= {0}), 0.0D)", "c": "count(value) FILTER (WHERE rn <= {0})"}
    g = rows.groupBy("series_id").agg(F.count("*").alias("nv"), *[F.expr(f"{e.format(x)} AS {c}{x}") for x in sizes for c, e in moments.items()])

    def width(size: int, k: float) -> str:
        m, reach = f"m{size}", f"{k}D * s{size}"
        if margin_pp is None:
            return f"(({m} + {reach}) - ({m} - {reach}))"
        return f"(least({m} + {reach} + {margin_pp}D, 100.01D) - greatest({m} - {reach} - {margin_pp}D, -0.01D))"

    def score(n: int, k: float) -> str:
        mean, own = f"m{n}", width(n, k)
        scale = f"if({mean} != 0, abs({mean}), 1.0D)" if margin_pp is None else f"if({mean} > 1, {mean}, 100.0D)"
        moves = [f"if(c{x} >= 3, greatest(abs(m{x} - {mean}) / {scale}, if({own} > 0, abs({width(x, k)} - {own}) / nullif({own}, 0), 0.0D)), 0.5D)" for x in nearby[n][1:]]
        return f"if(nv < {min_history + 4} OR c{n} < 3, 0.5D, transform(array(greatest({', '.join(moves)})), v -> CASE WHEN v < 0.05 THEN 1.0D WHEN v < 0.10 THEN 0.8D WHEN v < 0.20 THEN 0.6D WHEN v < 0.30 THEN 0.4D ELSE 0.2D END)[0])"

    every = ", ".join(f"struct({n} AS n, CAST({k} AS DOUBLE) AS k, {score(n, float(k))} AS stability_score)" for n in ns for k in sigmas)
    return g.selectExpr("series_id", f"inline(array({every}))")


def summary(s: DataFrame, points: DataFrame, stable: DataFrame | None = None, percent: bool = False, known_width: bool = False) -> DataFrame:
    """One row per series of `s`, zeros where nothing was evaluated.

    A failed point within four global deviations of the global mean counts as a false positive. The width is that of the
    last sigma band over its center, or over 100 for small percentages; 0 if the center is 0, or, with a known width, that of the last band whose center isn't.
    """
    moments = valid(s).groupBy("series_id").agg(F.avg("value").alias("gm"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("gs"))
    p = points.join(moments, "series_id")
    likely = ~F.col("passed") & (F.col("gs") > 0) & (F.abs(F.col("value") - F.col("gm")) < 4 * F.col("gs"))
    g = p.groupBy("series_id").agg(
        F.count("*").alias("total_periods"), F.count_if("passed").alias("periods_pass"), F.count_if(~F.col("passed")).alias("periods_fail"), F.count_if(likely).alias("false_positive_proxy"),
        F.max_by(F.struct("lower", "upper", "center"), F.when(F.col("center") != 0, F.col("idx")) if known_width else F.col("idx")).alias("b"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("period")))).alias("outlier_periods"),
    )
    c = F.col("b.center")
    scale = (F.when(c > 1, c).otherwise(F.lit(100.0))) if percent else F.when(c != 0, F.abs(c))
    g = g.withColumn("width", (F.col("b.upper") - F.col("b.lower")) / scale)
    ids = s.select("series_id").distinct()
    out = ids.join(g, "series_id", "left").join(weighted_coverage(points), "series_id", "left").join(drift(s).select("series_id", "has_drift"), "series_id", "left")
    if stable is not None:
        out = out.join(stable, "series_id", "left")
    else:
        out = out.withColumn("stability_score", F.col("periods_pass") / F.col("total_periods"))
    none = F.col("total_periods").isNull()
    zero = F.lit(0).cast("long")
    return out.select(
        "series_id", *[F.coalesce(x, zero).alias(x) for x in ("total_periods", "periods_pass", "periods_fail")], F.when(none, 0.0).otherwise(F.col("periods_pass") / F.col("total_periods") * 100).alias("coverage_pct"),
        F.coalesce("weighted_coverage_pct", F.lit(0.0)).alias("weighted_coverage_pct"), F.coalesce("false_positive_proxy", zero).alias("false_positive_proxy"), F.coalesce("width", F.lit(0.0)).alias("band_width_ratio"),
        F.when(none, 0.0).otherwise(F.coalesce("stability_score", F.lit(0.5))).alias("stability_score"), (~none & F.coalesce("has_drift", F.lit(False))).alias("has_drift"), F.coalesce("outlier_periods", F.array().cast("array<date>")).alias("outlier_periods"),
    )


def dual_guard_summary(s: DataFrame, n: int, k: float = 2.0, margin: float = 0.10, min_history: int = 7, margin_enabled: bool = True, known_width: bool = False) -> DataFrame:
    return summary(s, dual_guard(s, n, k, margin, min_history, margin_enabled), stability(s, n, k, min_history), known_width=known_width)


def frequency_summary(s: DataFrame, points: DataFrame, n: int, k: float, margin_pp: float, min_history: int = 7) -> DataFrame:
    return summary(s, points, stability(s, n, k, min_history, margin_pp), percent=True)


def _pointwise(rows: DataFrame, passed: Column, near: Column, trend_of: DataFrame, width: Column | None = None, weighted: bool = False) -> DataFrame:
    """Summary of checks without a window: coverage is stability, the trend is monotonic."""
    p = rows.withColumn("passed", passed).withColumn("near", near)
    g = p.groupBy("series_id").agg(
        F.count("*").alias("total_periods"), F.count_if("passed").alias("periods_pass"), F.count_if(~F.col("passed")).alias("periods_fail"), F.count_if(~F.col("passed") & F.col("near")).alias("false_positive_proxy"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("period")))).alias("outlier_periods"),
    )
    out = g.join(monotonic_trend(trend_of), "series_id", "left")
    cover = F.col("periods_pass") / F.col("total_periods")
    out = out.join(weighted_coverage(p), "series_id", "left") if weighted else out.withColumn("weighted_coverage_pct", F.lit(0.0))
    return out.select("series_id", "total_periods", "periods_pass", "periods_fail", (cover * 100).alias("coverage_pct"), "weighted_coverage_pct", "false_positive_proxy", (F.lit(0.0) if width is None else width).alias("band_width_ratio"), cover.alias("stability_score"), F.coalesce("has_trend", F.lit(False)).alias("has_drift"), "outlier_periods")


def distinct_exact(s: DataFrame, expected: int) -> DataFrame:
    v = F.bround("value")
    return _pointwise(valid(s), v == expected, F.abs(v - expected) == 1, s)


def distinct_range(s: DataFrame, lower: int, upper: int) -> DataFrame:
    v, center = F.bround("value"), (lower + upper) / 2
    return _pointwise(valid(s), v.between(lower, upper), v.isin(lower - 1, upper + 1), s, F.lit((upper - lower) / center if center > 0 else 0.0))


def allowed_values(observed: DataFrame, allowed: list[str], series_id: str = "values") -> DataFrame:
    """observed has period and values (a set); a null among them is no value."""
    known = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    rows = observed.select(F.lit(series_id).alias("series_id"), "period", F.size(F.array_except(F.array_compact("values"), known)).cast("double").alias("value"))
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("series_id").orderBy("period")) - 1)
    return _pointwise(rows, F.col("value") == 0, F.col("value") == 1, rows)


def completeness(s: DataFrame, threshold_pct: float) -> DataFrame:
    return _pointwise(valid(s), F.col("value") >= threshold_pct, F.abs(F.col("value") - threshold_pct) <= 2, s, weighted=True)


def primary_key(history: DataFrame, keys: list[str], series_id: str = "key") -> DataFrame:
    """From a uniqueness history: no duplicates and no nulls."""
    nulls = sum((F.col("total_rows") - F.col(f"non_null_{k}") for k in keys[1:]), F.col("total_rows") - F.col(f"non_null_{keys[0]}"))
    rows = history.select(F.lit(series_id).alias("series_id"), "period", F.col("duplicate_count").cast("double").alias("value"), nulls.alias("nulls"))
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("series_id").orderBy("period")) - 1)
    return _pointwise(rows, (F.col("value") == 0) & (F.col("nulls") == 0), (F.col("value") <= 1) & (F.col("nulls") <= 1), rows)


def streaks(points: DataFrame) -> DataFrame:
    """Runs of passes and failures (gaps and islands), violation rates overall, of the last 7, and of the last fifth."""
    w = Window.partitionBy("series_id").orderBy("idx")
    change = F.when(F.col("passed") != F.lag("passed").over(w), 1).otherwise(0)
    rows = points.select("series_id", "idx", "passed").withColumn("change", change).withColumn("island", F.sum("change").over(w))
    rows = rows.withColumns({"back": F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("idx").desc())), "n": F.count("*").over(Window.partitionBy("series_id"))})
    runs = rows.groupBy("series_id", "island").agg(F.count("*").alias("len"), F.first("passed").alias("kind"), F.max("idx").alias("end"))
    run = runs.groupBy("series_id").agg(F.max(F.when(~F.col("kind"), F.col("len"))).alias("max_fail_streak"), F.max(F.when(F.col("kind"), F.col("len"))).alias("max_pass_streak"), F.max_by("kind", "end").alias("k"), F.max_by("len", "end").alias("current_streak_length"))
    fail = F.when(F.col("passed"), 0.0).otherwise(1.0)
    tail = F.col("back") <= F.greatest(F.lit(1), F.expr("n div 5"))
    rate = rows.groupBy("series_id").agg(F.round(F.avg(fail), 4).alias("violation_rate"), F.round(F.avg(F.when(F.col("back") <= 7, fail)), 4).alias("recent_violation_rate"), F.round(F.avg(F.when(tail, fail)), 4).alias("tail_risk"), F.min(F.when(~F.col("passed"), F.col("idx"))).alias("first_fail_index"), F.max(F.when(~F.col("passed"), F.col("idx"))).alias("last_fail_index"))
    zero = F.lit(0).cast("long")
    return run.join(rate, "series_id").select("series_id", F.coalesce("max_fail_streak", zero).alias("max_fail_streak"), F.coalesce("max_pass_streak", zero).alias("max_pass_streak"), F.when(F.col("k"), "pass").otherwise("fail").alias("current_streak_type"), "current_streak_length", "violation_rate", "recent_violation_rate", "tail_risk", "first_fail_index", "last_fail_index")


def insights(analysis: DataFrame) -> DataFrame:
    """series_id, insights: what of the streaks and rates is worth saying."""
    v, r = F.col("violation_rate"), F.col("recent_violation_rate")
    said = F.array(
        F.when(F.col("max_fail_streak") >= 3, F.concat(F.lit("up to "), F.col("max_fail_streak").cast("string"), F.lit(" periods in a row failed"))),
        F.when((r > v * 1.5) & (r > 0.1), "recent periods fail more often than before"), F.when(F.col("tail_risk") > 0.30, "the newest fifth of periods fails often"),
        F.when((v == 0) & (F.col("max_pass_streak") > 0), "all evaluated periods passed"),
    )
    return analysis.select("series_id", F.filter(said, lambda x: x.isNotNull()).alias("insights"))


def frames(s: DataFrame, sizes: list[int]) -> DataFrame:
    """(series_id, idx, period, value, n, n_history, center, sd) for several frame sizes: one exchange, one sort."""
    cols = []
    for n in sizes:
        w = frame(n)
        cols.append(F.struct(F.lit(n).alias("n"), F.count("value").over(w).alias("n_history"), F.avg("value").over(w).alias("center"), F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0)).alias("sd")))
    wide = s.select("*", F.array(*cols).alias("_f"))
    return wide.select("series_id", "idx", "period", "value", F.explode("_f").alias("f")).select("series_id", "idx", "period", "value", "f.*")


__all__ = ["allowed_values", "completeness", "distinct_exact", "distinct_range", "dual_guard", "dual_guard_summary", "frames", "frequency_band", "frequency_dual_guard", "frequency_summary", "insights", "last", "primary_key", "stability", "streaks", "summary", "weighted_coverage"]
