"""The flagship query: daily history of events with rolling dual-guard bands and pass flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as BT
from ..operators import history as H
from ..operators import series as S
from . import base as B
from .registry import query, rounded

_POINTS = f"""WITH {B.EVENTS}, s AS (SELECT 'value' AS series_id, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS idx, period, avg(v) AS value FROM ev GROUP BY period), {B.rolling(10)}
SELECT series_id, idx, period, round(value, 6) AS value, round(m, 6) AS center, round(m - 2 * sd, 6) AS lower, round(m + 2 * sd, 6) AS upper, round(m - abs(m) * 0.1, 6) AS margin_lower, round(m + abs(m) * 0.1, 6) AS margin_upper,
 {B.inside('value', '(m - 2 * sd)', '(m + 2 * sd)')} OR {B.inside('value', '(m - abs(m) * 0.1)', '(m + abs(m) * 0.1)')} AS passed FROM b WHERE value IS NOT NULL AND m IS NOT NULL"""


@query(_POINTS)
def dual_guard_events(spark, sf_dir):
    s = S.series(H.numeric(B.events(spark, sf_dir), "v"), "mean", F.lit("value"))
    return rounded(BT.dual_guard(s, 10).drop("n_history"))
