"""Series analytics, regimes and backtests over the shared series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as BT
from ..operators import history as H
from ..operators import regime as R
from ..operators import series as S
from . import base as B
from .registry import query, rounded, table

N, K, M = 10, 2.0, 0.10
WITH = f"WITH {B.SERIES}"


def _tail(n: int) -> str:
    return f"t AS (SELECT series_id, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0.0) AS sd FROM valid WHERE rn <= {n} GROUP BY 1)"


@query(f"{WITH}, {_tail(20)} SELECT series_id, round(m, 6) AS center, round(m - 2 * sd, 6) AS lower, round(m + 2 * sd, 6) AS upper, n AS n_used FROM t WHERE n >= 3")
def band_sigma(spark, sf_dir):
    return rounded(S.sigma_band(B.all_series(spark, sf_dir), 20))


@query(f"{WITH}, {_tail(20)} SELECT series_id, round(m, 6) AS center, round(m - abs(m) * 0.1, 6) AS lower, round(m + abs(m) * 0.1, 6) AS upper, n AS n_used FROM t WHERE n >= 3")
def band_margin(spark, sf_dir):
    return rounded(S.margin_band(B.all_series(spark, sf_dir), 20))


def _shares(spark, sf_dir):
    d = H.distribution(B.events(spark, sf_dir), "event_type")
    return S.series(d, "value_pct", "category_value")


SHARES = f"""WITH {B.EVENTS}, raw AS (SELECT event_type AS series_id, period, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY period) AS value FROM ev GROUP BY 1, 2),
s AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY period) - 1 AS INTEGER) AS idx, period, CAST(value AS DOUBLE) AS value FROM raw), ids AS (SELECT DISTINCT series_id FROM s),
valid AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS x, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS rn, count(*) OVER (PARTITION BY series_id) AS nv FROM s WHERE value IS NOT NULL)"""


@query(f"{SHARES}, {_tail(20)} SELECT series_id, round(m, 6) AS center, round(greatest(m - 2 * sd - 3, -0.01), 6) AS lower, round(least(m + 2 * sd + 3, 100.01), 6) AS upper, n AS n_used FROM t WHERE n >= 3")
def band_frequency(spark, sf_dir):
    return rounded(S.frequency_band(_shares(spark, sf_dir), 20, 3.0, 2.0))


@query(f"""WITH {B.EVENTS}, h AS (SELECT event_type AS series_id, period, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS rn FROM h)
SELECT series_id, round((avg(lo) + avg(hi)) / 2 + 1e-8, 6) AS center, round(avg(lo) + 1e-8, 6) AS lower, round(avg(hi) + 1e-8, 6) AS upper, CAST(count(*) AS BIGINT) AS n_used FROM r WHERE rn <= 20 GROUP BY 1""")
def band_percentile(spark, sf_dir):
    h = H.numeric(B.events(spark, sf_dir), "v", segment="event_type", exact=True)
    b = S.percentile_band(S.series(h, "p05", "event_type"), S.series(h, "p95", "event_type"), 20).withColumn("n_used", F.col("n_used").cast("long"))
    # quantiles of cents end in whole digits, so ties are common: both engines round them up
    return rounded(b.withColumns({c: F.col(c) + 1e-8 for c in ("center", "lower", "upper")}))


IQR = "q AS (SELECT series_id, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM valid {where} GROUP BY 1)"
MAD = "md AS (SELECT series_id, count(*) AS n, quantile_cont(value, 0.5) AS med FROM valid {where} GROUP BY 1), ma AS (SELECT v.series_id, quantile_cont(abs(value - med), 0.5) AS mad FROM valid v JOIN md USING (series_id) {where} GROUP BY 1)"


@query(f"{WITH}, {IQR.format(where='WHERE rn <= 20')} SELECT series_id, round(q2, 6) AS center, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper, n AS n_used FROM q")
def band_iqr(spark, sf_dir):
    return rounded(S.iqr_band(B.all_series(spark, sf_dir), 20))


@query(f"{WITH}, {MAD.format(where='WHERE rn <= 20')} SELECT series_id, round(med, 6) AS center, round(med - 3 * 1.4826 * mad, 6) AS lower, round(med + 3 * 1.4826 * mad, 6) AS upper, n AS n_used FROM md JOIN ma USING (series_id)")
def band_mad(spark, sf_dir):
    return rounded(S.mad_band(B.all_series(spark, sf_dir), 20))


@query(f"{WITH}, {IQR.format(where='')} SELECT s.series_id, idx, period, round(value, 6) AS value FROM s JOIN q USING (series_id) WHERE value IS NOT NULL AND NOT {B.inside('value', '(q1 - 1.5 * (q3 - q1))', '(q3 + 1.5 * (q3 - q1))')}")
def outliers_iqr(spark, sf_dir):
    return rounded(S.outliers(B.all_series(spark, sf_dir)).select("series_id", "idx", "period", "value"))


@query(f"{WITH}, {MAD.format(where='')} SELECT s.series_id, idx, period, round(value, 6) AS value FROM s JOIN md USING (series_id) JOIN ma USING (series_id) WHERE value IS NOT NULL AND NOT {B.inside('value', '(med - 3 * 1.4826 * mad)', '(med + 3 * 1.4826 * mad)')}")
def outliers_mad(spark, sf_dir):
    return rounded(S.outliers(B.all_series(spark, sf_dir), "mad").select("series_id", "idx", "period", "value"))


@query(f"{WITH}, {B.rolling(N)} SELECT series_id, idx, period, round(value, 6) AS value, c AS n_history, round(m, 6) AS center, round(m - 2 * sd, 6) AS lower, round(m + 2 * sd, 6) AS upper, round(m - abs(m) * 0.1, 6) AS margin_lower, round(m + abs(m) * 0.1, 6) AS margin_upper FROM b")
def rolling_bands(spark, sf_dir):
    return rounded(S.rolling_bands(B.all_series(spark, sf_dir), N, K, M))


DRIFT = """dr AS (SELECT series_id, n, CASE WHEN n >= 5 AND lo < hi THEN slope ELSE 0.0 END AS slope, CASE WHEN n >= 5 AND lo < hi THEN r2 ELSE 0.0 END AS r2, m FROM (
 SELECT series_id, count(*) AS n, regr_slope(value, x) AS slope, power(corr(value, x), 2) AS r2, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM valid GROUP BY 1) q),
drift AS (SELECT series_id, n, slope, r2, r2 > 0.5 AND (m = 0 OR abs(slope) > 0.01 * abs(m)) AS has_drift FROM dr)"""


@query(f"{WITH}, {DRIFT} SELECT series_id, has_drift, round(slope, 6) AS slope, round(r2, 6) AS r_squared, n AS n_points FROM drift")
def drift(spark, sf_dir):
    return rounded(S.drift(B.all_series(spark, sf_dir)))


SEASON = """tot AS (SELECT series_id, count(*) AS n, avg(value) AS m, var_pop(value) AS var FROM valid GROUP BY 1),
dw AS (SELECT series_id, isodow(period) AS dow, count(*) AS k, avg(value) AS dm FROM valid GROUP BY 1, 2),
se AS (SELECT series_id, max(n) AS n, max(m) AS m, max(var) AS var, sum(k * power(dm - m, 2)) AS between_, max(dm) - min(dm) AS amplitude FROM dw JOIN tot USING (series_id) GROUP BY 1),
season AS (SELECT series_id, amplitude, CASE WHEN var > 0 THEN least(1.0, greatest(0.0, between_ / n / var)) ELSE 0.0 END AS strength, CASE WHEN abs(m) > 0 THEN amplitude / abs(m) ELSE 0.0 END AS ratio FROM se WHERE n >= 14)"""


@query(f"{WITH}, {SEASON} SELECT series_id, coalesce(strength > 0.15 AND ratio > 0.10, false) AS has_seasonality, round(coalesce(strength, 0.0), 5) AS strength, round(coalesce(amplitude, 0.0), 5) AS amplitude, round(coalesce(ratio, 0.0), 5) AS amplitude_ratio FROM ids LEFT JOIN season USING (series_id)")
def seasonality(spark, sf_dir):
    d = S.seasonality(B.all_series(spark, sf_dir))
    return d.select("series_id", "has_seasonality", *[F.round(c, 5).alias(c) for c in ("strength", "amplitude", "amplitude_ratio")])


CHANGE = """mom AS (SELECT series_id, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM valid GROUP BY 1 HAVING count(*) >= 10 AND stddev_samp(value) > 0),
z AS (SELECT v.series_id, v.x, (v.value - m) / sd AS z FROM valid v JOIN mom USING (series_id)),
cus AS (SELECT series_id, x, p, q, p > 4 OR q > 4 AS hit FROM (SELECT series_id, x, greatest(0.0, z - 0.5) AS p, greatest(0.0, -z - 0.5) AS q FROM z WHERE x = 0) a
 UNION ALL SELECT series_id, x, p, q, p > 4 OR q > 4 FROM (SELECT z.series_id, z.x, greatest(0.0, CASE WHEN hit THEN 0.0 ELSE p END + z.z - 0.5) AS p, greatest(0.0, CASE WHEN hit THEN 0.0 ELSE q END - z.z - 0.5) AS q FROM cus JOIN z ON z.series_id = cus.series_id AND z.x = cus.x + 1) b),
al AS (SELECT series_id, x, row_number() OVER (PARTITION BY series_id ORDER BY x) AS k FROM cus WHERE hit),
sp AS (SELECT series_id, k, CASE WHEN x >= 5 THEN x ELSE 0 END AS prev, x >= 5 AS keep, x FROM al WHERE k = 1
 UNION ALL SELECT al.series_id, al.k, CASE WHEN al.x - prev >= 5 THEN al.x ELSE prev END, al.x - prev >= 5, al.x FROM sp JOIN al ON al.series_id = sp.series_id AND al.k = sp.k + 1),
kept AS (SELECT sp.series_id, sp.x FROM sp JOIN mom USING (series_id) WHERE keep AND n - sp.x >= 5),
sg AS (SELECT v.series_id, v.x, v.value, v.idx, v.period, (SELECT count(*) FROM kept k WHERE k.series_id = v.series_id AND k.x <= v.x) AS part FROM valid v WHERE series_id IN (SELECT series_id FROM kept)),
st AS (SELECT series_id, part, avg(value) AS sm, coalesce(stddev_samp(value), 0.0) AS ss, min(idx) AS idx, min(period) AS period FROM sg GROUP BY 1, 2),
lst AS (SELECT *, lag(sm) OVER w AS pm, lag(ss) OVER w AS ps, first_value(sm) OVER w AS fm, lead(part) OVER w AS nxt FROM st WINDOW w AS (PARTITION BY series_id ORDER BY part)),
cp AS (SELECT l.series_id, l.idx AS change_idx, l.period AS change_period, CAST(l.part AS INTEGER) AS n_change_points, pm, sm, abs(sm - fm) AS magnitude, CAST((SELECT count(*) FROM s WHERE s.series_id = l.series_id) - l.idx AS INTEGER) AS n_post
 FROM lst l JOIN mom USING (series_id) WHERE nxt IS NULL AND abs(sm - pm) > 1.5 * coalesce(least(CASE WHEN ps > 0 THEN ps END, CASE WHEN ss > 0 THEN ss END), sd) AND abs(sm - pm) / CASE WHEN m <> 0 THEN abs(m) ELSE 1.0 END > 0.05)"""
RWITH = WITH.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{RWITH}, {CHANGE} SELECT series_id, change_idx, change_period, n_change_points, round(pm, 6) AS pre_mean, round(sm, 6) AS post_mean, round(magnitude, 6) AS magnitude, n_post FROM cp")
def change_points(spark, sf_dir):
    return rounded(S.change_points(B.all_series(spark, sf_dir)))


@query(f"""{WITH}, d AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS d FROM valid)
SELECT series_id, count(*) >= 5 AND greatest(count(*) FILTER (d > 0), count(*) FILTER (d < 0)) / greatest(count(d), 1) >= 0.7 AS has_trend FROM d GROUP BY 1""")
def monotonic_trend(spark, sf_dir):
    return S.monotonic_trend(B.all_series(spark, sf_dir))


SKEW = """sk AS (SELECT series_id, CASE WHEN count(*) >= 3 AND max(sd) >= 1e-10 THEN avg(power(value - m, 3)) / power(max(sd), 3) ELSE 0.0 END AS skewness
 FROM valid JOIN (SELECT series_id, avg(value) AS m, stddev_samp(value) AS sd FROM valid GROUP BY 1) q USING (series_id) GROUP BY 1)"""


@query(f"{WITH}, {SKEW} SELECT series_id, round(skewness, 6) AS skewness FROM sk")
def skewness(spark, sf_dir):
    return rounded(S.skewness(B.all_series(spark, sf_dir)))


FENCES = "fe AS (SELECT series_id, v[len(v) // 4 + 1] - 2.5 * (v[3 * len(v) // 4 + 1] - v[len(v) // 4 + 1]) AS low, v[3 * len(v) // 4 + 1] + 2.5 * (v[3 * len(v) // 4 + 1] - v[len(v) // 4 + 1]) AS high FROM (SELECT series_id, list(value ORDER BY value) AS v FROM valid GROUP BY 1) q WHERE len(v) >= 4)"


@query(f"{WITH}, {FENCES} SELECT series_id, round(low, 6) AS low, round(high, 6) AS high FROM fe")
def index_fences(spark, sf_dir):
    return rounded(S.index_fences(B.all_series(spark, sf_dir)))


OUT = "oc AS (SELECT series_id, count(*) AS k FROM valid JOIN q USING (series_id) WHERE NOT " + B.inside("value", "(q1 - 1.5 * (q3 - q1))", "(q3 + 1.5 * (q3 - q1))") + " GROUP BY 1)"
PROFILE = f"""{RWITH}, {DRIFT}, {SEASON}, {CHANGE}, {SKEW}, {IQR.format(where='')}, {OUT},
ba AS (SELECT series_id, count(*) AS n_points, count(value) AS n_valid, avg(value) AS m, coalesce(stddev_samp(value), 0.0) AS sd, count(*) FILTER (abs(value) < 1e-10) AS zeros FROM s GROUP BY 1),
me AS (SELECT ba.*, CASE WHEN abs(ba.m) > 1e-10 THEN ba.sd / abs(ba.m) ELSE 0.0 END AS cv, zeros / n_valid * 100 AS zero_pct, (n_points - n_valid) / n_points * 100 AS null_pct, skewness, slope, r2, has_drift, coalesce(strength, 0.0) AS strength, coalesce(ratio, 0.0) AS ratio,
 coalesce(oc.k, 0) AS n_outliers, coalesce(cp.n_post >= 5, false) AS broken, cp.n_post, change_period, magnitude
 FROM ba LEFT JOIN sk USING (series_id) LEFT JOIN drift USING (series_id) LEFT JOIN season USING (series_id) LEFT JOIN oc USING (series_id) LEFT JOIN cp USING (series_id)),
held AS (SELECT *, list_filter([CASE WHEN broken THEN 'STRUCTURAL_BREAK' END, CASE WHEN has_drift THEN 'TRENDING' END, CASE WHEN strength > 0.15 AND ratio > 0.10 THEN 'SEASONAL' END, CASE WHEN zero_pct >= 30 THEN 'ZERO_INFLATED' END, CASE WHEN null_pct >= 30 THEN 'SPARSE' END, CASE WHEN cv > 0.30 THEN 'VOLATILE' END, CASE WHEN abs(skewness) > 1 THEN 'ASYMMETRIC' END], lambda x: x IS NOT NULL) AS h FROM me),
prof AS (SELECT *, CASE WHEN len(h) > 0 THEN h[1] ELSE 'STABLE' END AS regime, array_to_string(h[2:], ',') AS secondary FROM held)"""


@query(f"{PROFILE} SELECT series_id, n_points, n_valid, regime, secondary, round(cv, 4) AS cv, round(skewness, 4) AS skewness, round(zero_pct, 2) AS zero_pct, round(null_pct, 2) AS null_pct, n_outliers AS n_outliers_iqr, round(r2, 4) AS drift_r_squared, round(strength, 4) AS seasonality_strength, CASE WHEN broken THEN change_period END AS change_point_date FROM prof")
def series_profile(spark, sf_dir):
    p = R.series_profile(B.all_series(spark, sf_dir))
    return p.select("series_id", "n_points", "n_valid", "regime", F.array_join("secondary_regimes", ",").alias("secondary"), "cv", "skewness", "zero_pct", "null_pct", "n_outliers_iqr", "drift_r_squared", "seasonality_strength", "change_point_date")


@query(f"""{PROFILE}, bu AS (SELECT series_id, regime, unnest(CASE regime
 WHEN 'VOLATILE' THEN [{{'t': 'MEAN_DUAL_GUARD', 'n': 30, 'k': 3.0}}, {{'t': 'NUMERIC_PERCENTILE_BAND', 'n': NULL, 'k': NULL}}, {{'t': 'ROW_COUNT_DUAL_GUARD', 'n': NULL, 'k': NULL}}, {{'t': 'COMPLETENESS', 'n': NULL, 'k': NULL}}]
 WHEN 'ASYMMETRIC' THEN [{{'t': 'NUMERIC_PERCENTILE_BAND', 'n': NULL, 'k': NULL}}, {{'t': 'ROW_COUNT_DUAL_GUARD', 'n': NULL, 'k': NULL}}, {{'t': 'COMPLETENESS', 'n': NULL, 'k': NULL}}]
 WHEN 'TRENDING' THEN [{{'t': 'MEAN_DUAL_GUARD', 'n': CASE WHEN round(r2, 4) > 0.7 THEN 10 ELSE 15 END, 'k': 2.0}}, {{'t': 'ROW_COUNT_DUAL_GUARD', 'n': NULL, 'k': NULL}}, {{'t': 'COMPLETENESS', 'n': NULL, 'k': NULL}}]
 WHEN 'SEASONAL' THEN [{{'t': 'MEAN_DUAL_GUARD', 'n': 28, 'k': 2.5}}, {{'t': 'ROW_COUNT_DUAL_GUARD', 'n': 14, 'k': NULL}}, {{'t': 'COMPLETENESS', 'n': NULL, 'k': NULL}}]
 WHEN 'STRUCTURAL_BREAK' THEN [{{'t': 'MEAN_DUAL_GUARD', 'n': greatest(n_valid // 3, 10), 'k': 2.0}}, {{'t': 'STDDEV_DUAL_GUARD', 'n': greatest(n_valid // 3, 10), 'k': 2.0}}, {{'t': 'ROW_COUNT_DUAL_GUARD', 'n': NULL, 'k': NULL}}, {{'t': 'COMPLETENESS', 'n': NULL, 'k': NULL}}]
 WHEN 'STABLE' THEN [{{'t': 'MEAN_DUAL_GUARD', 'n': 30, 'k': 2.0}}, {{'t': 'STDDEV_DUAL_GUARD', 'n': 30, 'k': 2.0}}, {{'t': 'ROW_COUNT_DUAL_GUARD', 'n': NULL, 'k': NULL}}, {{'t': 'COMPLETENESS', 'n': NULL, 'k': NULL}}]
 ELSE [{{'t': 'COMPLETENESS', 'n': NULL, 'k': NULL}}, {{'t': 'ROW_COUNT_DUAL_GUARD', 'n': NULL, 'k': NULL}}] END) AS r FROM prof)
SELECT series_id, regime, r.t AS rule_type, CAST(r.n AS INTEGER) AS suggested_n, CAST(r.k AS DOUBLE) AS suggested_sigma FROM bu""")
def strategy_bundle(spark, sf_dir):
    return R.strategy(R.series_profile(B.all_series(spark, sf_dir)))


POINTS = f"""{B.rolling(N)}, pt AS (SELECT *, {B.inside('value', '(m - 2 * sd)', '(m + 2 * sd)')} OR {B.inside('value', '(m - abs(m) * 0.1)', '(m + abs(m) * 0.1)')} AS passed, m - 2 * sd AS lower, m + 2 * sd AS upper
 FROM b WHERE value IS NOT NULL AND m IS NOT NULL AND series_id IN (SELECT series_id FROM valid WHERE nv >= 7))"""
WEIGHT = "wc AS (SELECT series_id, round(sum(CASE WHEN passed THEN w ELSE 0.0 END) / sum(w) * 100, 2) AS weighted FROM (SELECT series_id, passed, exp(-0.05 * (row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) - 1)) AS w FROM pt) q GROUP BY 1)"


def stability_sql(n: int, k: float, pp: float | None = None, mh: int = 7) -> str:
    sizes = (n, max(mh, n - 2), max(mh, n + 2))
    cols = ", ".join(f"avg(value) FILTER (rn <= {z}) AS m{i}, coalesce(stddev_samp(value) FILTER (rn <= {z}), 0.0) AS s{i}, count(*) FILTER (rn <= {z}) AS c{i}" for i, z in enumerate(sizes))
    lo = lambda i: f"(m{i} - {k} * s{i})" if pp is None else f"greatest(m{i} - {k} * s{i} - {pp}, -0.01)"
    hi = lambda i: f"(m{i} + {k} * s{i})" if pp is None else f"least(m{i} + {k} * s{i} + {pp}, 100.01)"
    wid = lambda i: f"({hi(i)} - {lo(i)})"
    scale = "CASE WHEN m0 <> 0 THEN abs(m0) ELSE 1.0 END" if pp is None else "CASE WHEN m0 > 1 THEN m0 ELSE 100.0 END"
    move = lambda i: f"CASE WHEN c{i} >= 3 THEN greatest(abs(m{i} - m0) / {scale}, CASE WHEN {wid(0)} > 0 THEN abs({wid(i)} - {wid(0)}) / {wid(0)} ELSE 0.0 END) ELSE 0.5 END"
    return f"""sb AS (SELECT series_id, CASE WHEN nv < {mh + 4} OR c0 < 3 THEN 0.5 WHEN d < 0.05 THEN 1.0 WHEN d < 0.10 THEN 0.8 WHEN d < 0.20 THEN 0.6 WHEN d < 0.30 THEN 0.4 ELSE 0.2 END AS stability
 FROM (SELECT *, greatest({move(1)}, {move(2)}) AS d FROM (SELECT series_id, count(*) AS nv, {cols} FROM valid GROUP BY 1) a) c)"""


def summary_sql(scale: str) -> str:
    return f"""gm AS (SELECT series_id, avg(value) AS gm, coalesce(stddev_samp(value), 0.0) AS gs FROM valid GROUP BY 1),
 sm AS (SELECT series_id, count(*) AS total, count(*) FILTER (passed) AS ok, count(*) FILTER (NOT passed) AS bad, count(*) FILTER (NOT passed AND gs > 0 AND abs(value - gm) < 4 * gs) AS fp,
  arg_max((upper - lower) / {scale}, idx) AS width, array_to_string(list(period ORDER BY period) FILTER (NOT passed), ',') AS outs FROM pt JOIN gm USING (series_id) GROUP BY 1)"""


SUMMARY_COLUMNS = """coalesce(total, 0) AS total_periods, coalesce(ok, 0) AS periods_pass, coalesce(bad, 0) AS periods_fail, round(coalesce(ok / total * 100, 0.0), 6) AS coverage_pct, coalesce(weighted, 0.0) AS weighted_coverage_pct,
 coalesce(fp, 0) AS false_positive_proxy, round(coalesce(width, 0.0), 5) AS band_width_ratio, CASE WHEN total IS NULL THEN 0.0 ELSE CAST(stability AS DOUBLE) END AS stability_score, total IS NOT NULL AND coalesce(has_drift, false) AS has_drift, coalesce(outs, '') AS outlier_periods"""
SUMMARY_FROM = "FROM ids LEFT JOIN sm USING (series_id) LEFT JOIN wc USING (series_id) LEFT JOIN sb USING (series_id) LEFT JOIN drift USING (series_id)"


def shown(summary):
    """A summary as plain columns, each rounded once."""
    out = summary.withColumn("outlier_periods", F.array_join(F.col("outlier_periods").cast("array<string>"), ","))
    return rounded(out, band_width_ratio=5)


@query(f"{WITH}, {POINTS} SELECT series_id, idx, period, round(value, 6) AS value, round(m, 6) AS center, round(lower, 6) AS lower, round(upper, 6) AS upper, passed FROM pt")
def bt_dual_guard_points(spark, sf_dir):
    return rounded(BT.dual_guard(B.all_series(spark, sf_dir), N).select("series_id", "idx", "period", "value", "center", "lower", "upper", "passed"))


@query(f"{WITH}, {POINTS}, {WEIGHT}, {DRIFT}, {stability_sql(N, 2.0)}, {summary_sql('nullif(abs(m), 0)')} SELECT series_id, {SUMMARY_COLUMNS} {SUMMARY_FROM}")
def bt_dual_guard_summary(spark, sf_dir):
    return shown(BT.dual_guard_summary(B.all_series(spark, sf_dir), N))


FREQ_POINTS = f"{B.rolling(N)}, pt AS (SELECT *, {B.inside('value', 'lower', 'upper')} AS passed FROM (SELECT *, greatest(m - 2 * sd - 1, -0.01) AS lower, least(m + 2 * sd + 1, 100.01) AS upper FROM b WHERE value IS NOT NULL AND m IS NOT NULL) q)"
PCT_SCALE = "CASE WHEN m > 1 THEN m ELSE 100.0 END"


@query(f"{SHARES}, {FREQ_POINTS}, {WEIGHT}, {DRIFT}, {stability_sql(N, 2.0, 1.0)}, {summary_sql(PCT_SCALE)} SELECT series_id, {SUMMARY_COLUMNS} {SUMMARY_FROM}")
def bt_frequency_static(spark, sf_dir):
    s = _shares(spark, sf_dir)
    return shown(BT.frequency_summary(s, BT.frequency_band(s, N, 1.0, 2.0), N, 2.0, 1.0))


def _guard_points(extra: str = "") -> str:
    return f"{B.rolling(N)}, pt AS (SELECT *, ({B.inside('value', 'lower', 'upper')} OR {B.inside('value', '(m * 0.9 - 0.01)', '(m * 1.1 + 0.01)')}) {extra} AS passed FROM (SELECT *, m - 2 * sd - 0.01 AS lower, m + 2 * sd + 0.01 AS upper FROM b WHERE value IS NOT NULL AND m IS NOT NULL) q)"


@query(f"{SHARES}, {_guard_points()}, {WEIGHT}, {DRIFT}, {stability_sql(N, 2.0, 10.0)}, {summary_sql(PCT_SCALE)} SELECT series_id, {SUMMARY_COLUMNS} {SUMMARY_FROM}")
def bt_frequency_dynamic(spark, sf_dir):
    s = _shares(spark, sf_dir)
    return shown(BT.frequency_summary(s, BT.frequency_dual_guard(s, N), N, 2.0, 10.0))


@query(f"{SHARES}, {_guard_points('AND value BETWEEN 18.5 AND 24.0')}, {WEIGHT}, {DRIFT}, {stability_sql(N, 2.0, 10.0)}, {summary_sql(PCT_SCALE)} SELECT series_id, {SUMMARY_COLUMNS} {SUMMARY_FROM}")
def bt_frequency_hybrid(spark, sf_dir):
    s = _shares(spark, sf_dir)
    return shown(BT.frequency_summary(s, BT.frequency_dual_guard(s, N, floor=18.5, ceiling=24.0), N, 2.0, 10.0))


DISTINCT = f"WITH {B.EVENTS}, s AS (SELECT 'user_id' AS series_id, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS idx, period, value FROM (SELECT period, CAST(count(DISTINCT user_id) AS DOUBLE) AS value FROM ev GROUP BY 1) q)"


def plain_sql(passed: str, near: str, width: str = "0.0", weighted: str = "0.0") -> str:
    return f"""pt AS (SELECT *, {passed} AS passed, {near} AS near FROM s WHERE value IS NOT NULL), d AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS d FROM s WHERE value IS NOT NULL),
tr AS (SELECT series_id, count(*) >= 5 AND greatest(count(*) FILTER (d > 0), count(*) FILTER (d < 0)) / greatest(count(d), 1) >= 0.7 AS has_trend FROM d GROUP BY 1),
{WEIGHT}
SELECT pt.series_id, count(*) AS total_periods, count(*) FILTER (passed) AS periods_pass, count(*) FILTER (NOT passed) AS periods_fail, round(count(*) FILTER (passed) / count(*) * 100, 6) AS coverage_pct, {weighted} AS weighted_coverage_pct,
 count(*) FILTER (NOT passed AND near) AS false_positive_proxy, round(CAST({width} AS DOUBLE), 5) AS band_width_ratio, round(count(*) FILTER (passed) / count(*), 6) AS stability_score, any_value(has_trend) AS has_drift, coalesce(array_to_string(list(period ORDER BY period) FILTER (NOT passed), ','), '') AS outlier_periods
FROM pt JOIN tr USING (series_id) JOIN wc USING (series_id) GROUP BY 1"""


def _user_counts(spark, sf_dir):
    h = H.distinct_counts(B.events(spark, sf_dir), "user_id", exact=True)
    return S.series(h, "distinct_count", F.lit("user_id"))


@query(f"{DISTINCT}, {plain_sql('value = 135', 'abs(value - 135) = 1', weighted='CAST(0.0 AS DOUBLE)')}")
def bt_distinct_exact(spark, sf_dir):
    return shown(BT.distinct_exact(_user_counts(spark, sf_dir), 135))


@query(f"{DISTINCT}, {plain_sql('value BETWEEN 130 AND 140', 'value IN (129, 141)', '10 / 135.0', 'CAST(0.0 AS DOUBLE)')}")
def bt_distinct_range(spark, sf_dir):
    return shown(BT.distinct_range(_user_counts(spark, sf_dir), 130, 140))


@query(f"""WITH {B.EVENTS}, o AS (SELECT period, count(DISTINCT event_type) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS n FROM ev GROUP BY 1),
s AS (SELECT 'values' AS series_id, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS idx, period, CAST(n AS DOUBLE) AS value FROM o), {plain_sql('value = 0', 'value = 1', weighted='CAST(0.0 AS DOUBLE)')}""")
def bt_allowed_values(spark, sf_dir):
    return shown(BT.allowed_values(H.observed_values(B.events(spark, sf_dir), "event_type"), ["click", "view", "purchase"]))


@query(f"""WITH {B.EVENTS}, s AS (SELECT 'v' AS series_id, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS idx, period, round_even(count(v) / count(*) * 100, 2) AS value FROM ev GROUP BY period),
{plain_sql('value >= 94', 'abs(value - 94) <= 2', weighted='any_value(weighted)')}""")
def bt_completeness(spark, sf_dir):
    s = S.series(H.completeness(H.numeric(B.events(spark, sf_dir), "v")), "value", F.lit("v"))
    return shown(BT.completeness(s, 94.0))


@query(f"""WITH l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CAST(l_orderkey AS VARCHAR) || '|' || CAST(CASE WHEN l_partkey % 500 <> 0 THEN l_linenumber END AS VARCHAR) AS k, CASE WHEN l_partkey % 500 <> 0 THEN l_linenumber END AS line FROM lineitem),
h AS (SELECT period, CAST(count(*) - count(DISTINCT k) AS DOUBLE) AS value, count(*) - count(line) AS nulls FROM l GROUP BY 1), s AS (SELECT 'key' AS series_id, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS idx, * FROM h), {plain_sql('value = 0 AND nulls = 0', 'value <= 1 AND nulls <= 1', weighted='CAST(0.0 AS DOUBLE)')}""")
def bt_primary_key(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.trunc(F.to_date("l_shipdate"), "MM").alias("period"), "l_orderkey", F.when(F.col("l_partkey") % 500 != 0, F.col("l_linenumber")).alias("line"))  # noqa: E741
    return shown(BT.primary_key(H.uniqueness(l, ["l_orderkey", "line"]), ["l_orderkey", "line"]))


@query(f"{WITH}, {stability_sql(N, 2.0)} SELECT series_id, CAST(stability AS DOUBLE) AS stability_score FROM sb")
def bt_stability(spark, sf_dir):
    return BT.stability(B.all_series(spark, sf_dir), N, 2.0)


@query(f"{WITH}, {POINTS}, {WEIGHT} SELECT series_id, weighted AS weighted_coverage_pct FROM wc")
def bt_weighted_coverage(spark, sf_dir):
    return BT.weighted_coverage(BT.dual_guard(B.all_series(spark, sf_dir), N))


STREAKS = """isl AS (SELECT *, sum(ch) OVER (PARTITION BY series_id ORDER BY idx) AS island FROM (SELECT series_id, idx, passed, CASE WHEN passed <> lag(passed) OVER (PARTITION BY series_id ORDER BY idx) THEN 1 ELSE 0 END AS ch FROM pt) q),
runs AS (SELECT series_id, island, count(*) AS len, any_value(passed) AS kind, max(idx) AS e FROM isl GROUP BY 1, 2),
bk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS back, count(*) OVER (PARTITION BY series_id) AS n FROM pt),
rt AS (SELECT series_id, round(avg(CASE WHEN passed THEN 0.0 ELSE 1.0 END), 4) AS violation_rate, round(avg(CASE WHEN passed THEN 0.0 ELSE 1.0 END) FILTER (back <= 7), 4) AS recent_violation_rate, round(avg(CASE WHEN passed THEN 0.0 ELSE 1.0 END) FILTER (back <= greatest(1, n // 5)), 4) AS tail_risk, min(idx) FILTER (NOT passed) AS first_fail_index, max(idx) FILTER (NOT passed) AS last_fail_index FROM bk GROUP BY 1),
an AS (SELECT series_id, coalesce(max(len) FILTER (NOT kind), 0) AS max_fail_streak, coalesce(max(len) FILTER (kind), 0) AS max_pass_streak, CASE WHEN arg_max(kind, e) THEN 'pass' ELSE 'fail' END AS current_streak_type, arg_max(len, e) AS current_streak_length FROM runs GROUP BY 1)"""


@query(f"{WITH}, {POINTS}, {STREAKS} SELECT * FROM an JOIN rt USING (series_id)")
def bt_streaks(spark, sf_dir):
    return BT.streaks(BT.dual_guard(B.all_series(spark, sf_dir), N))


@query(f"""{WITH}, {POINTS}, {STREAKS} SELECT series_id, array_to_string(list_filter([CASE WHEN max_fail_streak >= 3 THEN 'up to ' || max_fail_streak || ' periods in a row failed' END, CASE WHEN recent_violation_rate > violation_rate * 1.5 AND recent_violation_rate > 0.1 THEN 'recent periods fail more often than before' END,
 CASE WHEN tail_risk > 0.30 THEN 'the newest fifth of periods fails often' END, CASE WHEN violation_rate = 0 AND max_pass_streak > 0 THEN 'all evaluated periods passed' END], lambda x: x IS NOT NULL), '; ') AS insights FROM an JOIN rt USING (series_id)""")
def bt_insights(spark, sf_dir):
    a = BT.insights(BT.streaks(BT.dual_guard(B.all_series(spark, sf_dir), N)))
    return a.select("series_id", F.array_join("insights", "; ").alias("insights"))
