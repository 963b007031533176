"""Analytics on many series at once: rows of (series_id, idx, period, value), null where a period has no value.

Every operator groups or windows by series_id, so series spread over tasks and one exchange serves them all.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slack for comparisons with a band: means of equal doubles differ in the last bits.
EPS = 1e-9
MAD_FACTOR = 1.4826
WEEKDAYS = 7
_holding: ContextVar[list | None] = ContextVar("holding", default=None)


@contextmanager
def holding():
    """Series that operators persist inside are given back at the end, so write or collect what rests on them before.

    A service that profiles many tables uses one for each; without it they stay until the session ends or storage runs short.
    """
    frames: list[DataFrame] = []
    token = _holding.set(frames)
    try:
        yield
    finally:
        _holding.reset(token)
        for s in frames:
            s.unpersist()


def held(s: DataFrame) -> DataFrame:
    """The series persisted, for operators that read it several times; a row per period."""
    frames, level = _holding.get(), s.storageLevel
    known = level.useMemory or level.useDisk
    s = s.persist()
    if frames is not None and not known:
        frames.append(s)
    return s


def series(df: DataFrame, value: str | Column, series_id: str | Column) -> DataFrame:
    """The canonical form of a history: NaN becomes null, idx counts periods from 0.

    A literal of its own tells each from equal ones made before: Spark knows persisted rows by plan, and would give old ones for tables rewritten in place.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    key = (F.col(series_id) if isinstance(series_id, str) else series_id).cast("string")
    rows = df.select(key.alias("series_id"), "period", F.nanvl(v, F.lit(None).cast("double")).alias("value")).where(F.lit(uuid.uuid4().hex).isNotNull())
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy("series_id").orderBy("period")) - 1).cast("int")).select("series_id", "idx", "period", "value")


def unpivoted(history: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """Several metrics of one history as several series, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(prefix + c).alias("series_id"), F.col(c).cast("double").alias("value")) for c in columns]))
    return series(history.select("period", pairs.alias("m")).select("period", "m.series_id", "m.value"), "value", "series_id")


def valid(s: DataFrame) -> DataFrame:
    return s.where(F.col("value").isNotNull())


def last(s: DataFrame, n: int | Column) -> DataFrame:
    """The last n valid points of each series."""
    w = Window.partitionBy("series_id").orderBy(F.col("idx").desc())
    return valid(s).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def within(x: Column, lower: Column, upper: Column) -> Column:
    return (x >= lower - EPS * F.greatest(F.lit(1.0), F.abs(lower))) & (x <= upper + EPS * F.greatest(F.lit(1.0), F.abs(upper)))


def _band(agg: DataFrame, center: Column, lower: Column, upper: Column, n: Column | None = None) -> DataFrame:
    return agg.select("series_id", center.alias("center"), lower.alias("lower"), upper.alias("upper"), (F.col("n") if n is None else n).alias("n_used"))


def _moments(s: DataFrame, n: int) -> DataFrame:
    return last(s, n).groupBy("series_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("s"))


def sigma_band(s: DataFrame, n: int, k: float = 2.0) -> DataFrame:
    """Mean of the last n valid points, k sample deviations either way; series with fewer than 3 have none."""
    return _band(_moments(s, n).where("n >= 3"), F.col("m"), F.col("m") - k * F.col("s"), F.col("m") + k * F.col("s"))


def margin_band(s: DataFrame, n: int, margin: float = 0.10) -> DataFrame:
    width = F.abs("m") * margin
    return _band(_moments(s, n).where("n >= 3"), F.col("m"), F.col("m") - width, F.col("m") + width)


def frequency_band(s: DataFrame, n: int, margin_pp: float, k: float) -> DataFrame:
    """For percentages: sigma and a margin in points, clamped just outside 0 and 100."""
    reach = k * F.col("s") + margin_pp
    return _band(_moments(s, n).where("n >= 3"), F.col("m"), F.greatest(F.col("m") - reach, F.lit(-0.01)), F.least(F.col("m") + reach, F.lit(100.01)))


def percentile_band(low: DataFrame, high: DataFrame, n: int) -> DataFrame:
    """From two quantile histories of a series: means of the last points of either, as many as both have."""
    sizes = valid(low).groupBy("series_id").agg(F.count("*").alias("a")).join(valid(high).groupBy("series_id").agg(F.count("*").alias("b")), "series_id")
    sizes = sizes.select("series_id", F.least("a", "b", F.lit(n)).alias("u")).where("u >= 3")
    def tail(x: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("series_id").orderBy(F.col("idx").desc())
        rows = valid(x).withColumn("_rn", F.row_number().over(w)).join(sizes, "series_id").where("_rn <= u")
        return rows.groupBy("series_id").agg(F.avg("value").alias(name), F.max("u").alias("n"))
    both = tail(low, "lower").join(tail(high, "upper").drop("n"), "series_id")
    return both.select("series_id", ((F.col("lower") + F.col("upper")) / 2).alias("center"), "lower", "upper", F.col("n").alias("n_used"))


def iqr_band(s: DataFrame, n: int, factor: float = 1.5) -> DataFrame:
    """Quartile fences of the last n; with fewer than 3 points a point at their mean, or at 0."""
    q = last(s, n).groupBy("series_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    all_ids = s.select("series_id").distinct().join(q, "series_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few, iqr, flat = F.col("n") < 3, F.col("q")[2] - F.col("q")[0], F.coalesce("m", F.lit(0.0))
    return _band(all_ids, F.when(few, flat).otherwise(F.col("q")[1]), F.when(few, flat).otherwise(F.col("q")[0] - factor * iqr), F.when(few, flat).otherwise(F.col("q")[2] + factor * iqr))


def mad_band(s: DataFrame, n: int, factor: float = 3.0) -> DataFrame:
    """Median and scaled median absolute deviation of the last n; degenerate like the quartile band."""
    rows = last(s, n)
    mid = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.percentile("value", F.lit(0.5)).alias("med"))
    dev = rows.join(mid.select("series_id", "med"), "series_id").groupBy("series_id").agg(F.percentile(F.abs(F.col("value") - F.col("med")), F.lit(0.5)).alias("mad"))
    all_ids = s.select("series_id").distinct().join(mid.join(dev, "series_id"), "series_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few, flat, reach = F.col("n") < 3, F.coalesce("m", F.lit(0.0)), factor * MAD_FACTOR * F.col("mad")
    return _band(all_ids, F.when(few, flat).otherwise(F.col("med")), F.when(few, flat).otherwise(F.col("med") - reach), F.when(few, flat).otherwise(F.col("med") + reach))


def outliers(s: DataFrame, method: str = "iqr", n: int | None = None, factor: float | None = None) -> DataFrame:
    """Valid points outside the band of the last n, which applies to all of the series."""
    size = n if n is not None else 1 << 30
    band = iqr_band(s, size, factor or 1.5) if method == "iqr" else mad_band(s, size, factor or 3.0)
    rows = valid(s).join(band, "series_id")
    return rows.where(~within(F.col("value"), F.col("lower"), F.col("upper"))).select("series_id", "idx", "period", "value", "lower", "upper")


def index_fences(s: DataFrame, factor: float = 2.5) -> DataFrame:
    """series_id, low, high: fences from the quartiles by position, which calibration leaves points out by; four points at least."""
    g = valid(s).groupBy("series_id").agg(F.array_sort(F.collect_list("value")).alias("v")).where(F.size("v") >= 4)
    q1, q3 = F.element_at("v", F.expr("size(v) div 4 + 1").cast("int")), F.element_at("v", F.expr("3 * size(v) div 4 + 1").cast("int"))
    return g.select("series_id", (q1 - factor * (q3 - q1)).alias("low"), (q3 + factor * (q3 - q1)).alias("high"))


def frame(n: int) -> Window:
    """The n rows before the current one, valid or not."""
    return Window.partitionBy("series_id").orderBy("idx").rowsBetween(-n, -1)


def rolling_bands(s: DataFrame, n: int, k: float = 2.0, margin: float = 0.10, min_history: int = 7) -> DataFrame:
    """Sigma and margin band before each point; null where the frame has too few valid points."""
    w = frame(n)
    out = s.withColumns({"_c": F.count("value").over(w), "_m": F.avg("value").over(w), "_s": F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0))})
    ok = F.col("_c") >= F.lit(max(min_history, 3))
    m, sd = F.when(ok, F.col("_m")), F.when(ok, F.col("_s"))
    return out.select(
        "series_id", "idx", "period", "value", F.col("_c").alias("n_history"), m.alias("center"), (m - k * sd).alias("lower"), (m + k * sd).alias("upper"),
        (m - F.abs(m) * margin).alias("margin_lower"), (m + F.abs(m) * margin).alias("margin_upper"),
    )


def drift(s: DataFrame, window: int | None = None) -> DataFrame:
    """Least-squares slope over the position among valid points; a constant series has none.

    r_squared is the square of the correlation, as in SQL: c * c / (vx * vy) puts one of exactly 0.5 above its limit far more often.
    """
    rows = last(s, window) if window else valid(s)
    x = (F.row_number().over(Window.partitionBy("series_id").orderBy("idx")) - 1).cast("double")
    g = rows.withColumn("x", x).groupBy("series_id").agg(F.count("*").alias("n"), F.covar_pop("value", "x").alias("c"), F.var_pop("value").alias("vy"), F.var_pop("x").alias("vx"), F.avg("value").alias("m"))
    known = (F.col("n") >= 5) & (F.col("vy") > 0)
    slope, r2 = F.when(known, F.col("c") / F.col("vx")).otherwise(F.lit(0.0)), F.when(known, F.pow(F.col("c") / (F.sqrt("vx") * F.sqrt("vy")), F.lit(2.0))).otherwise(F.lit(0.0))
    steep = F.when(F.col("m") != 0, F.abs(slope) > 0.01 * F.abs("m")).otherwise(F.lit(True))
    all_ids = s.select("series_id").distinct().join(g, "series_id", "left")
    return all_ids.select("series_id", F.coalesce(known & (r2 > 0.5) & steep, F.lit(False)).alias("has_drift"), F.coalesce(slope, F.lit(0.0)).alias("slope"), F.coalesce(r2, F.lit(0.0)).alias("r_squared"), F.coalesce("n", F.lit(0)).alias("n_points"))


def seasonality(s: DataFrame, min_periods: int = 14) -> DataFrame:
    """Share of the variance between weekdays, and the amplitude of their means."""
    rows = valid(s).withColumn("dow", F.weekday("period"))
    total = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("var"))
    days = rows.where(F.col("dow").isNotNull()).groupBy("series_id", "dow").agg(F.count("*").alias("k"), F.avg("value").alias("dm"))
    g = days.join(total, "series_id").groupBy("series_id").agg(
        F.max("n").alias("n"), F.max("m").alias("m"), F.max("var").alias("var"), F.sum(F.col("k") * F.pow(F.col("dm") - F.col("m"), 2)).alias("between"),
        (F.max("dm") - F.min("dm")).alias("amplitude"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("dow", "dm")))).alias("weekday_means"),
    )
    g = g.where(F.col("n") >= min_periods)
    strength = F.when(F.col("var") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("between") / F.col("n") / F.col("var")))).otherwise(F.lit(0.0))
    ratio = F.when(F.abs("m") > 0, F.col("amplitude") / F.abs("m")).otherwise(F.lit(0.0))
    g = g.withColumn("strength", strength).withColumn("ratio", ratio)
    out = s.select("series_id").distinct().join(g, "series_id", "left")
    zero = F.lit(0.0)
    return out.select("series_id", F.coalesce((F.col("strength") > 0.15) & (F.col("ratio") > 0.10), F.lit(False)).alias("has_seasonality"), F.coalesce("strength", zero).alias("strength"), F.coalesce("amplitude", zero).alias("amplitude"), F.coalesce("ratio", zero).alias("amplitude_ratio"), "weekday_means")


def change_points(s: DataFrame, threshold: float = 4.0, min_segment: int = 5, slack: float = 0.5) -> DataFrame:
    """Bilateral CUSUM with reset, spaced, confirmed by the difference of the last two segments.

    A series is one array of at most some hundred periods; two folds over it replace the loop, inside codegen-free but native expressions.
    change_idx is the idx in the series with its invalid points; n_post counts points from there on, invalid ones too.
    """
    pts = F.array_sort(F.collect_list(F.struct("idx", "period", "value")))
    g = valid(s).groupBy("series_id").agg(pts.alias("v"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.count("*").cast("int").alias("n"))
    g = g.where((F.col("n") >= 2 * min_segment) & (F.col("sd") > 0))
    start = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        z = (x["value"] - F.col("m")) / F.col("sd")
        pos = F.greatest(F.lit(0.0), acc["pos"] + z - slack)
        neg = F.greatest(F.lit(0.0), acc["neg"] - z - slack)
        hit = (pos > threshold) | (neg > threshold)
        return F.struct(F.when(hit, 0.0).otherwise(pos).alias("pos"), F.when(hit, 0.0).otherwise(neg).alias("neg"), (acc["i"] + 1).alias("i"), F.when(hit, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"))

    def spaced(acc: Column, c: Column) -> Column:
        far = c - acc["prev"] >= min_segment
        return F.struct(F.when(far, c).otherwise(acc["prev"]).alias("prev"), F.when(far, F.concat(acc["kept"], F.array(c))).otherwise(acc["kept"]).alias("kept"))

    g = g.withColumn("alarms", F.aggregate("v", start, step, lambda a: a["at"]))
    g = g.withColumn("kept", F.aggregate("alarms", F.struct(F.lit(0).alias("prev"), F.array().cast("array<int>").alias("kept")), spaced, lambda a: a["kept"]))
    g = g.withColumn("kept", F.filter("kept", lambda c: F.col("n") - c >= min_segment)).where(F.size("kept") > 0)
    bounds = F.concat(F.array(F.lit(0)), F.col("kept"), F.array(F.col("n")))
    g = g.withColumn("b", bounds).withColumn("part", F.explode(F.sequence(F.lit(0), F.size("kept"))))
    segment = F.slice("v", F.element_at("b", F.col("part") + 1) + 1, F.element_at("b", F.col("part") + 2) - F.element_at("b", F.col("part") + 1))
    points = g.select("series_id", "m", "sd", "n", "kept", "v", "part", F.explode(segment).alias("p"))
    stats = points.groupBy("series_id", "part").agg(F.first("m").alias("m"), F.first("sd").alias("sd"), F.first("n").alias("n"), F.first("kept").alias("kept"), F.first("v").alias("v"), F.avg("p.value").alias("sm"), F.coalesce(F.stddev_samp("p.value"), F.lit(0.0)).alias("ss"))
    w = Window.partitionBy("series_id").orderBy("part")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stats = stats.withColumns({"pre_m": F.lag("sm").over(w), "pre_s": F.lag("ss").over(w), "first_m": F.first("sm").over(whole)}).where(F.col("part") == F.size("kept"))
    inner = F.coalesce(F.least(F.when(F.col("pre_s") > 0, F.col("pre_s")), F.when(F.col("ss") > 0, F.col("ss"))), F.col("sd"))
    gap = F.abs(F.col("sm") - F.col("pre_m"))
    confirmed = (gap > 1.5 * inner) & (gap / F.when(F.col("m") != 0, F.abs("m")).otherwise(F.lit(1.0)) > 0.05)
    at = F.element_at("v", F.element_at("kept", -1) + 1)
    found = stats.where(confirmed).select("series_id", at["idx"].alias("change_idx"), at["period"].alias("change_period"), F.size("kept").alias("n_change_points"), F.col("pre_m").alias("pre_mean"), F.col("sm").alias("post_mean"), F.abs(F.col("sm") - F.col("first_m")).alias("magnitude"))
    sizes = s.groupBy("series_id").agg(F.count("*").alias("_size"))
    return found.join(sizes, "series_id").withColumn("n_post", (F.col("_size") - F.col("change_idx")).cast("int")).drop("_size")


def after_change(s: DataFrame, changes: DataFrame, min_points: int = 5) -> DataFrame:
    """The points from a confirmed change on, where it leaves enough; else the whole series."""
    cut = changes.where(F.col("n_post") >= min_points).select("series_id", "change_idx")
    return s.join(cut, "series_id", "left").where(F.col("change_idx").isNull() | (F.col("idx") >= F.col("change_idx"))).drop("change_idx")


def monotonic_trend(s: DataFrame, share: float = 0.7) -> DataFrame:
    """Whether that share of consecutive differences has one sign; five valid points at least."""
    d = F.col("value") - F.lag("value").over(Window.partitionBy("series_id").orderBy("idx"))
    g = valid(s).withColumn("d", d).groupBy("series_id").agg(F.count("*").alias("n"), F.count("d").alias("k"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    return g.select("series_id", ((F.col("n") >= 5) & (F.greatest("up", "down") / F.greatest("k", F.lit(1)) >= share)).alias("has_trend"))


def skewness(s: DataFrame) -> DataFrame:
    """Third population moment over the cubed sample deviation; 0 for few points or none spread."""
    g = valid(s).groupBy("series_id").agg(F.count("*").alias("n"), F.skewness("value").alias("k"), F.stddev_samp("value").alias("sd"))
    known = (F.col("n") >= 3) & (F.col("sd") >= 1e-10)
    return g.select("series_id", F.when(known, F.col("k") * F.pow((F.col("n") - 1) / F.col("n"), F.lit(1.5))).otherwise(F.lit(0.0)).alias("skewness"))
