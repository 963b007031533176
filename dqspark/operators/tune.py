"""Calibration and grid search: all series and all parameter tuples in one plan.

Frames of several sizes share one exchange and sort; bands are arithmetic on top. Choosing is an aggregate over candidates, never
a loop over series; a series' measures are one short array, out of which calibration chooses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.spec import DAILY, Grain
from . import backtest as BT
from . import series as S

SIGMAS, MARGINS, WIDER = (2.0, 2.5, 3.0), (0.05, 0.10, 0.15, 0.20), (0.25, 0.30)
ENOUGH, MIN_EVALUATED, RECENT = 0.98, 5, 7
GRID_N, GRID_SIGMA = (10, 15, 20, 30, 45), (1.0, 1.5, 2.0, 2.5, 3.0)
WEEKS = (7, 14, 21, 28, 35, 42)


def choose_n(profile: DataFrame, grain: Grain = DAILY) -> DataFrame:
    """series_id, n: the grain's default, less where a break or a short series leaves fewer points, a whole number of weeks for seasonal days."""
    default, valid = F.lit(grain.default_n), F.col("n_valid").cast("int")
    broken = F.coalesce(F.col("has_structural_break") & (F.col("n_post") >= 5), F.lit(False))
    n = F.when(broken, F.least(default, F.greatest(F.col("n_post") - 2, F.lit(5)))).otherwise(default)
    out = profile.withColumn("_n", n).withColumn("_n", F.when(valid < 2 * F.col("_n"), F.greatest(F.expr("n_valid div 2").cast("int"), F.lit(5))).otherwise(F.col("_n")))
    if grain.seasonal:
        week = F.lit(WEEKS[0])
        for w in WEEKS[1:]:
            week = F.when(F.abs(F.lit(w) - F.col("_n")) < F.abs(week - F.col("_n")), w).otherwise(week)
        out = out.withColumn("_n", F.when(F.col("is_seasonal") & (week <= F.expr("n_valid div 2")), week).otherwise(F.col("_n")))
    return out.select("series_id", F.col("_n").cast("int").alias("n"))


def own_frames(s: DataFrame, sizes: DataFrame, min_history: int = 7, largest: int = max(WEEKS)) -> DataFrame:
    """Moments of the n rows before each point, where n is the series' own and `largest` at most: of one frame per point, the last n."""
    w = Window.partitionBy("series_id").orderBy("idx").rowsBetween(-largest, -1)
    at = s.withColumn("_f", F.collect_list(F.struct("idx", "value")).over(w)).where(F.col("value").isNotNull()).join(sizes, "series_id")
    own = F.filter("_f", lambda x: (x["idx"] >= F.col("idx") - F.col("n")) & x["value"].isNotNull())
    at = at.withColumn("_b", F.transform(own, lambda x: x["value"])).withColumn("n_history", F.size("_b")).where(F.col("n_history") >= max(min_history, 3))
    total = F.aggregate("_b", F.lit(0.0), lambda acc, v: acc + v)
    at = at.withColumn("center", total / F.col("n_history"))
    spread = F.aggregate("_b", F.lit(0.0), lambda acc, v: acc + (v - F.col("center")) * (v - F.col("center")))
    return at.withColumn("sd", F.sqrt(spread / (F.col("n_history") - 1))).select("series_id", "idx", "period", "value", "n", "n_history", "center", "sd")


def _passes(k: Column, margin: Column, enabled: Column) -> Column:
    m, reach = F.col("center"), k * F.col("sd")
    wide = F.abs(m) * margin
    return S.within(F.col("value"), m - reach, m + reach) | (enabled & S.within(F.col("value"), m - wide, m + wide))


def _combos(sigmas, margins) -> Column:
    """All combinations as an array, by SQL text: so many literals would be as many calls into the JVM."""
    off = [f"struct({k}D AS k, 0.0D AS margin, false AS enabled)" for k in sigmas]
    return F.expr("array(" + ", ".join(off + [f"struct({k}D AS k, {m}D AS margin, true AS enabled)" for k in sigmas for m in margins]) + ")")


def _measured(points: DataFrame, s: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage, coverage of normal points, recent failures, false positives and weighted coverage by series and combination."""
    fences = S.index_fences(s)
    moments = S.valid(s).groupBy("series_id").agg(F.avg("value").alias("gm"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("gs"))
    p = points.join(fences, "series_id", "left").join(moments, "series_id")
    normal = F.col("low").isNull() | F.col("value").between(F.col("low"), F.col("high"))
    back = F.row_number().over(Window.partitionBy("series_id", *keys).orderBy(F.col("idx").desc()))
    p = p.withColumns({"_normal": normal, "_back": back, "_fp": ~F.col("passed") & (F.col("gs") > 0) & (F.abs(F.col("value") - F.col("gm")) < 4 * F.col("gs"))}).withColumn("_w", F.exp(-BT.RECENCY * (F.col("_back") - 1)))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    cover = F.avg(one(F.col("passed")))
    return p.groupBy("series_id", *keys).agg(
        F.count("*").alias("total"), (cover * 100).alias("coverage_pct"), F.coalesce(F.avg(F.when(F.col("_normal"), one(F.col("passed")))), cover).alias("normal_coverage"),
        F.coalesce(F.avg(F.when(~F.col("_normal"), one(F.col("passed")))), F.lit(0.0)).alias("outlier_share"), F.count_if((F.col("_back") <= RECENT) & ~F.col("passed")).alias("recent_fails"), F.count_if("_fp").alias("false_positives"),
        F.round(F.sum(F.when(F.col("passed"), F.col("_w")).otherwise(0.0)) / F.sum("_w") * 100, 2).alias("weighted_coverage_pct"), F.max_by(F.struct("center", "sd"), "idx").alias("last"),
    )


def calibrate(s: DataFrame, profile: DataFrame, grain: Grain = DAILY) -> DataFrame:
    """series_id, n, sigma, margin_pct, margin_enabled, coverage, false positives, recent failures, confidence, viable.

    The smallest sigma that covers enough normal points alone; else the best one with the smallest margin that does; then the margin
    is raised until none of the last points fails, if any margin achieves that.
    """
    sizes = choose_n(profile, grain).join(profile.select("series_id", "n_valid"), "series_id")
    points = own_frames(s, sizes.select("series_id", "n"), grain.min_history, max(*WEEKS, grain.default_n)).withColumn("c", F.explode(_combos(SIGMAS, (*MARGINS, *WIDER)))).select("*", "c.*").drop("c")
    points = points.withColumn("passed", _passes(F.col("k"), F.col("margin"), F.col("enabled")))
    m = _measured(points, s, ["k", "margin", "enabled"])
    # a series' combinations are one array, out of which everything is chosen
    fields = ("k", "margin", "enabled", "total", "coverage_pct", "normal_coverage", "recent_fails", "false_positives", "weighted_coverage_pct")
    base = sizes.join(m.groupBy("series_id").agg(F.collect_list(F.struct(*fields)).alias("_all")), "series_id", "left")
    base = base.withColumn("_all", F.coalesce("_all", F.array().cast("array<struct<k:double,margin:double,enabled:boolean,total:bigint,coverage_pct:double,normal_coverage:double,recent_fails:bigint,false_positives:bigint,weighted_coverage_pct:double>>")))

    def best(rows: Column, key: str) -> Column:
        """The first that covers enough, else the first of those that cover most; null if there is none."""
        rank = lambda x: F.when(x["normal_coverage"] >= ENOUGH, F.lit(2.0)).otherwise(x["normal_coverage"])
        return F.array_max(F.transform(rows, lambda x: F.struct(rank(x).alias("rank"), (-x[key]).alias("least"), x["normal_coverage"].alias("normal_coverage"))))

    base = base.withColumn("_s", best(F.filter("_all", lambda x: ~x["enabled"] & (x["total"] >= MIN_EVALUATED)), "k"))
    base = base.withColumn("sigma", F.coalesce(F.when(F.col("_s.normal_coverage") > 0, -F.col("_s.least")), F.lit(SIGMAS[0]))).withColumn("alone", F.coalesce(F.col("_s.normal_coverage") >= ENOUGH, F.lit(False)))
    base = base.withColumn("_own", F.filter("_all", lambda x: x["k"] == F.col("sigma")))
    base = base.withColumn("_m", best(F.filter("_own", lambda x: x["enabled"] & (x["total"] >= MIN_EVALUATED) & x["margin"].isin(*MARGINS)), "margin"))
    first = F.coalesce(F.when(F.col("_m.normal_coverage") > 0, -F.col("_m.least")), F.lit(MARGINS[0]))
    base = base.withColumn("start", F.when(F.col("alone"), 0.0).otherwise(first))

    def wider(x: Column) -> Column:
        """From no margin up: the four candidates; from a margin up: 5 and 10 points more, or 20, 25, 30 percent."""
        more = F.round(x["margin"] - F.col("start"), 4)
        step = F.when(F.col("start") == 0, x["margin"].isin(*MARGINS)).otherwise((x["margin"] > F.col("start")) & (more.isin(0.05, 0.10) | x["margin"].isin(0.20, 0.25, 0.30)))
        return x["enabled"] & (x["recent_fails"] == 0) & step

    now = F.filter("_own", lambda x: F.when(F.col("start") == 0, ~x["enabled"]).otherwise(x["enabled"] & (x["margin"] == F.col("start"))))
    relaxed = F.array_min(F.transform(F.filter("_own", wider), lambda x: x["margin"]))
    base = base.withColumns({"fails_now": F.coalesce(F.try_element_at(now, F.lit(1))["recent_fails"], F.lit(0)), "wider": relaxed})
    base = base.withColumn("margin_pct", F.when((F.col("fails_now") > 0) & F.col("wider").isNotNull(), F.col("wider")).otherwise(F.col("start"))).withColumn("margin_enabled", F.col("margin_pct") > 0)
    got = F.try_element_at(F.filter("_own", lambda x: (x["margin"] == F.col("margin_pct")) & (x["enabled"] == F.col("margin_enabled"))), F.lit(1))
    out = base.withColumn("_g", got).select("series_id", "n", "n_valid", "sigma", "margin_pct", "margin_enabled", "_g.coverage_pct", "_g.weighted_coverage_pct", "_g.false_positives", "_g.recent_fails")
    cover, fp = F.coalesce("coverage_pct", F.lit(0.0)), F.coalesce("false_positives", F.lit(0))
    enough = F.col("n_valid") >= MIN_EVALUATED
    confidence = F.when(~enough, "LOW").when((cover >= 90) & (fp == 0), "HIGH").when(cover >= 70, "MEDIUM").otherwise("LOW")
    return out.select(
        "series_id", F.when(enough, F.col("n")).otherwise(F.lit(grain.default_n)).alias("n"), F.when(enough, F.col("sigma")).otherwise(F.lit(2.0)).alias("sigma"), F.when(enough, F.col("margin_pct")).otherwise(F.lit(0.0)).alias("margin_pct"), (enough & F.col("margin_enabled")).alias("margin_enabled"),
        F.when(enough, cover).otherwise(F.lit(0.0)).alias("coverage_pct"), F.when(enough, F.coalesce("weighted_coverage_pct", F.lit(0.0))).otherwise(F.lit(0.0)).alias("weighted_coverage_pct"), F.when(enough, fp).otherwise(F.lit(0)).cast("long").alias("false_positives"),
        F.coalesce("recent_fails", F.lit(0)).cast("long").alias("recent_fails"), confidence.alias("confidence"), (enough & (cover >= 70)).alias("viable"),
    )


def grid_search(s: DataFrame, ns=GRID_N, sigmas=GRID_SIGMA, margins=MARGINS, seasonal: bool = True, min_history: int = 7, few: int = 15, min_coverage: float = 70.0) -> DataFrame:
    """The best of all combinations by series, with its score; ties go to the earlier one in grid order.

    The score rewards normal coverage, stability, no drift, weekly frames of seasonal series, frames after a change, and recency; it
    penalises covered outliers, false positives, wide bands, short frames, and large sigmas and margins.
    """
    pts = BT.frames(s, list(ns)).where(F.col("value").isNotNull() & (F.col("n_history") >= max(min_history, 3)))
    every = [(k, m, on) for k in sigmas for m in margins for on in ("true", "false")]
    combos = F.expr("array(" + ", ".join(f"struct({k}D AS k, {m}D AS margin, {on} AS enabled, {i} AS order)" for i, (k, m, on) in enumerate(every)) + ")")
    pts = pts.withColumn("c", F.explode(combos)).select("*", "c.*").drop("c").withColumn("passed", _passes(F.col("k"), F.col("margin"), F.col("enabled")))
    g = _measured(pts, s, ["n", "k", "margin", "enabled", "order"])
    stable = BT.stabilities(s, ns, sigmas, min_history)
    changes = S.change_points(s).select("series_id", "n_post")
    season = S.seasonality(s).select("series_id", (F.col("has_seasonality") & (F.col("amplitude_ratio") > 0.10)).alias("weekly"))
    g = g.join(stable, ["series_id", "n", "k"], "left").join(S.drift(s).select("series_id", "has_drift"), "series_id").join(changes, "series_id", "left").join(season, "series_id", "left")
    width = F.when(F.col("last.center") != 0, 2 * F.col("k") * F.col("last.sd") / F.abs(F.col("last.center"))).otherwise(F.lit(0.0))
    gain = F.greatest(F.col("weighted_coverage_pct") - F.col("coverage_pct"), F.lit(0.0)) / 100 * 0.10
    post = F.coalesce(F.when((F.col("n_post") >= 5) & (F.col("n") <= F.col("n_post")), 0.03), F.lit(0.0))
    week = F.when(F.lit(seasonal) & F.coalesce("weekly", F.lit(False)) & (F.col("n") % 7 == 0), 0.02).otherwise(0.0)
    score = (
        F.col("normal_coverage") - F.col("outlier_share") * 0.15 - F.col("false_positives") * 0.05 + F.col("stability_score") * 0.10 - F.pow(F.greatest(width - 0.20, F.lit(0.0)), 2) * 0.5
        + F.when(F.col("has_drift"), -0.05).otherwise(0.05) - F.when(F.col("n") < few, 0.05).otherwise(0.0) - F.col("k") * 0.02 - F.col("margin") * 0.10 + week + post + gain
    )
    g = g.withColumn("score", F.round(score, 9))
    first = Window.partitionBy("series_id").orderBy(F.col("score").desc(), "n", "order")
    best = g.withColumn("_r", F.row_number().over(first)).where((F.col("_r") == 1) & (F.col("score") > -1))
    confidence = F.when((F.col("coverage_pct") >= 90) & (F.col("false_positives") == 0), "HIGH").when(F.col("coverage_pct") >= min_coverage, "MEDIUM").otherwise("LOW")
    return best.select("series_id", F.col("n").cast("int").alias("n"), F.col("k").alias("sigma"), F.col("margin").alias("margin_pct"), F.col("enabled").alias("margin_enabled"), "coverage_pct", "weighted_coverage_pct", F.col("false_positives").cast("long").alias("false_positives"), F.col("stability_score").alias("stability"), F.round("score", 4).alias("score_total"), confidence.alias("confidence"), (F.col("coverage_pct") >= min_coverage).alias("viable"))
