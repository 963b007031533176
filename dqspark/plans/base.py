"""Inputs that the registered queries share, in Spark and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import series as S
from .registry import table

EVENT_DAY, ORDER_DAY, SHIP_DAY = "2024-01-30", "2001-08-01", "2001-11-04"
STEP_FROM = "1998-06-01"


def events(spark, sf_dir) -> DataFrame:
    """Events with their day and a value that is null for every seventeenth id."""
    return table(spark, sf_dir, "events").withColumn("period", F.to_date("ts")).withColumn("v", F.when(F.col("event_id") % 17 != 0, F.col("value")))


EVENTS = "ev AS (SELECT *, CAST(ts AS DATE) AS period, CASE WHEN event_id % 17 <> 0 THEN value END AS v FROM events)"


def all_series(spark, sf_dir) -> DataFrame:
    """Daily and monthly series of many shapes: by event type, sparse, zero-inflated, trending, seasonal, flat, and with a step."""
    ev = events(spark, sf_dir)
    by_type = ev.groupBy(F.concat(F.lit("events:"), "event_type").alias("series_id"), "period").agg(F.avg("v").alias("value"))
    day = ev.groupBy("period").agg(F.avg("v").alias("a"), F.count("*").cast("double").alias("n"))
    dom, saturday = F.dayofmonth("period"), F.when(F.weekday("period") == 5, 1.5).otherwise(1.0)
    shapes = {"count": F.col("n"), "sparse": F.when(dom % 3 != 0, F.col("a")), "zero": F.when(dom % 3 == 0, F.col("a")).otherwise(F.lit(0.0)), "trend": F.col("a") + 5.0 * dom, "season": F.col("a") * saturday, "flat": F.lit(7.5)}
    daily = day.select("period", F.explode(F.array(*[F.struct(F.lit("events:" + k).alias("series_id"), c.alias("value")) for k, c in shapes.items()])).alias("x")).select("x.series_id", "period", "x.value")
    orders = table(spark, sf_dir, "orders").select(F.trunc(F.to_date("o_orderdate"), "MM").alias("period"), "o_orderstatus", "o_totalprice")
    by_status = orders.groupBy(F.concat(F.lit("orders:"), "o_orderstatus").alias("series_id"), "period").agg(F.avg("o_totalprice").alias("value"))
    factor = F.when(F.col("period") >= F.lit(STEP_FROM).cast("date"), 3.0).otherwise(1.0)
    step = orders.groupBy("period").agg(F.count("*").alias("n")).select(F.lit("orders:step").alias("series_id"), "period", (F.col("n") * factor).alias("value"))
    return S.series(by_type.unionByName(daily).unionByName(by_status).unionByName(step), "value", "series_id")


SERIES = f"""
{EVENTS},
dayagg AS (SELECT period, avg(v) AS a, CAST(count(*) AS DOUBLE) AS n, day(period) AS dom FROM ev GROUP BY period),
ord AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderstatus, o_totalprice FROM orders),
raw AS (
  SELECT 'events:' || event_type AS series_id, period, avg(v) AS value FROM ev GROUP BY ALL
  UNION ALL SELECT 'events:count', period, n FROM dayagg
  UNION ALL SELECT 'events:sparse', period, CASE WHEN dom % 3 <> 0 THEN a END FROM dayagg
  UNION ALL SELECT 'events:zero', period, CASE WHEN dom % 3 = 0 THEN a ELSE 0.0 END FROM dayagg
  UNION ALL SELECT 'events:trend', period, a + 5.0 * dom FROM dayagg
  UNION ALL SELECT 'events:season', period, a * CASE WHEN isodow(period) = 6 THEN 1.5 ELSE 1.0 END FROM dayagg
  UNION ALL SELECT 'events:flat', period, CAST(7.5 AS DOUBLE) FROM dayagg
  UNION ALL SELECT 'orders:' || o_orderstatus, period, avg(o_totalprice) FROM ord GROUP BY ALL
  UNION ALL SELECT 'orders:step', period, count(*) * CASE WHEN period >= DATE '{STEP_FROM}' THEN 3.0 ELSE 1.0 END FROM ord GROUP BY period
),
s AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY period) - 1 AS INTEGER) AS idx, period, CAST(value AS DOUBLE) AS value FROM raw),
ids AS (SELECT DISTINCT series_id FROM s),
valid AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS x, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS rn, count(*) OVER (PARTITION BY series_id) AS nv FROM s WHERE value IS NOT NULL)
"""


def inside(x: str, lo: str, hi: str) -> str:
    """Band membership with the engine's slack."""
    return f"({x} >= {lo} - 1e-9 * greatest(1.0, abs({lo})) AND {x} <= {hi} + 1e-9 * greatest(1.0, abs({hi})))"


def rolling(n: int, min_history: int = 7, name: str = "b") -> str:
    return f"""{name} AS (
  SELECT series_id, idx, period, value, c, CASE WHEN c >= {max(min_history, 3)} THEN m END AS m, CASE WHEN c >= {max(min_history, 3)} THEN sd END AS sd FROM (
    SELECT *, count(value) OVER w AS c, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0.0) AS sd
    FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) q)"""
