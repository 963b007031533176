"""Scans, filters, histories, profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import dates, sampling
from ..operators import history as H
from ..operators import profile as P
from ..sources import catalog, predicates
from ..sources.spec import SourceSpec
from . import base as B
from .registry import query, rounded, table

QUANTILE_SQL = ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for q, n in zip(H.QUANTILES, H.quantile_names()))


def numeric_sql(source: str, keys: str = "period") -> str:
    return f"""SELECT {keys}, count(*) AS total_count, count(v) AS non_null_count, count(*) - count(v) AS null_count,
  round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value, {QUANTILE_SQL}
FROM {source} GROUP BY {keys}"""


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value, CAST(ts AS DATE) AS period FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'")
def scan_events_window(spark, sf_dir):
    spec = SourceSpec("events", date_column="ts", lookback=10, reference_day=B.EVENT_DAY)
    return rounded(spec.resolve(spark, table(spark, sf_dir, "events")).select("event_id", "user_id", "event_type", "value", "period"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y%m') >= '200005' GROUP BY 1")
def partition_predicate_single(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("anomes", F.date_format("o_orderdate", "yyyyMM"))
    p = predicates.partition_since(["anomes"], date(2000, 5, 17), {"anomes": "yyyyMM"})
    return o.where(p).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-05-17' GROUP BY 1")
def partition_predicate_ymd(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.date_format("o_orderdate", "MM").alias("m"), F.dayofmonth("o_orderdate").alias("d"))
    p = predicates.partition_since(["y", "m", "d"], date(2000, 5, 17), {"y": "yyyy", "m": "MM", "d": "dd"}, {"y": True, "d": True})
    return o.where(p).groupBy("y").agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS period, count(*) AS row_count FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' AND (value > 10 OR user_id < 50) AND event_type = 'click' GROUP BY 1")
def base_and_subpop_filter(spark, sf_dir):
    spec = SourceSpec("events", date_column="ts", lookback=20, reference_day=B.EVENT_DAY, base_filter="value > 10 OR user_id < 50").with_segment("event_type = 'click'")
    return H.row_count(spec.resolve(spark, table(spark, sf_dir, "events")))


@query("""SELECT CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n,
count(*) AS from_text, count(*) AS from_int, count(*) AS from_month, count(*) AS from_epoch, CAST(0 AS BIGINT) AS from_bad FROM orders GROUP BY 1, 2""")
def date_axis_formats(spark, sf_dir):
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select(day.alias("d"), F.date_format(day, "dd/MM/yyyy").alias("t"), F.date_format(day, "yyyyMMdd").cast("int").alias("i"), F.date_format(day, "yyyyMM").alias("ym"), F.unix_timestamp(day.cast("timestamp")).alias("e"))
    same = lambda c, fmt, want: F.count_if(dates.as_day(F.col(c), fmt) == want)
    return o.groupBy("d", dates.month_of(F.col("d")).alias("m")).agg(F.count("*").alias("n"), same("t", "dd/MM/yyyy", F.col("d")).alias("from_text"), same("i", "yyyyMMdd", F.col("d")).alias("from_int"), same("ym", "yyyyMM", F.trunc("d", "MM")).alias("from_month"), same("e", "epoch_s", F.col("d")).alias("from_epoch"), F.count(dates.as_day(F.concat("ym", F.lit("x")), "yyyyMMdd")).alias("from_bad"))


@query()
def distinct_sample(spark, sf_dir):
    return catalog.sample_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@query()
def tablesample_profile(spark, sf_dir):
    spec = SourceSpec("events", date_column="ts", lookback=30, reference_day=B.EVENT_DAY, sample_pct=20.0)
    return H.numeric(spec.resolve(spark, table(spark, sf_dir, "events"), sampled=True), "value")


@query("SELECT DISTINCT o_orderstatus AS value FROM orders")
def partition_values_scan(spark, sf_dir):
    return catalog.scanned_values(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'int'), (1, 'r_name', 'string')) v(position, column_name, physical_type)")
def column_discovery(spark, sf_dir):
    return catalog.column_table(table(spark, sf_dir, "region")).where("position < 2")


@query("SELECT CAST(ts AS DATE) AS period, count(*) AS row_count FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' GROUP BY 1")
def row_count_history(spark, sf_dir):
    return H.row_count(SourceSpec("events", date_column="ts", lookback=20, reference_day=B.EVENT_DAY).resolve(spark, table(spark, sf_dir, "events")))


@query("SELECT CAST(o_orderdate AS DATE) AS period, count(*) AS row_count FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 50")
def volume_by_period(spark, sf_dir):
    return H.volume(table(spark, sf_dir, "orders").withColumn("period", F.to_date("o_orderdate")))


@query("SELECT CAST(min(l_shipdate) AS DATE) AS min_period, CAST(max(l_shipdate) AS DATE) AS max_period, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_periods FROM lineitem")
def date_range(spark, sf_dir):
    return H.date_range(table(spark, sf_dir, "lineitem").withColumn("period", F.to_date("l_shipdate")))


@query(f"WITH {B.EVENTS} {numeric_sql('ev')}")
def numeric_history_daily(spark, sf_dir):
    return rounded(H.numeric(B.events(spark, sf_dir), "v", exact=True))


@query("WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_totalprice AS v FROM orders WHERE date_trunc('month', o_orderdate) >= DATE '1999-08-02') " + numeric_sql("o"))
def numeric_history_monthly(spark, sf_dir):
    spec = SourceSpec("orders", date_column="o_orderdate", grain="monthly", lookback=730, reference_day=B.ORDER_DAY)
    return rounded(H.numeric(spec.resolve(spark, table(spark, sf_dir, "orders")), "o_totalprice", exact=True))


@query(f"WITH {B.EVENTS} {numeric_sql('ev', 'period, event_type')}")
def numeric_history_segment(spark, sf_dir):
    return rounded(H.numeric(B.events(spark, sf_dir), "v", segment="event_type", exact=True))


@query()
def numeric_history_approx(spark, sf_dir):
    return H.numeric(B.events(spark, sf_dir), "v")


@query("SELECT CAST(ts AS DATE) AS period, count(DISTINCT CAST(user_id AS VARCHAR)) AS distinct_count, count(*) AS total_count, count(user_id) AS non_null_count FROM events GROUP BY 1")
def distinct_history_exact(spark, sf_dir):
    return H.distinct_counts(B.events(spark, sf_dir), "user_id", exact=True)


@query()
def distinct_history_approx(spark, sf_dir):
    return H.distinct_counts(B.events(spark, sf_dir), "user_id")


@query(f"WITH {B.EVENTS} SELECT period, event_type AS category_value, count(*) AS value_count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY period), 6) AS value_pct FROM ev GROUP BY 1, 2")
def categorical_distribution(spark, sf_dir):
    return rounded(H.distribution(B.events(spark, sf_dir), "event_type"))


@query("SELECT o_orderpriority AS category_value, count(*) AS value_count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS value_pct FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def categorical_domain_topk(spark, sf_dir):
    return rounded(H.domain(table(spark, sf_dir, "orders"), "o_orderpriority", 3))


@query(f"""WITH {B.EVENTS}, few AS (SELECT period, event_type AS v, count(*) AS n FROM ev GROUP BY 1, 2), p AS (SELECT DISTINCT period FROM few), c AS (SELECT DISTINCT v FROM few)
SELECT p.period, c.v AS category_value, coalesce(f.n, 0) AS value_count, round(coalesce(f.n * 100.0 / sum(f.n) OVER (PARTITION BY p.period), 0.0), 6) AS value_pct
FROM p CROSS JOIN c LEFT JOIN few f ON f.period = p.period AND f.v = c.v""")
def categorical_densified(spark, sf_dir):
    return rounded(H.densified(H.distribution(B.events(spark, sf_dir), "event_type")))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS total_rows, count(DISTINCT o_orderkey) AS distinct_keys, count(*) - count(DISTINCT o_orderkey) AS duplicate_count, count(o_orderkey) AS non_null_o_orderkey FROM orders GROUP BY 1")
def uniqueness_single(spark, sf_dir):
    return H.uniqueness(table(spark, sf_dir, "orders").withColumn("period", F.trunc(F.to_date("o_orderdate"), "MM")), ["o_orderkey"])


@query("""WITH l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_orderkey, CASE WHEN l_partkey % 50 <> 0 THEN l_linenumber END AS line FROM lineitem)
SELECT period, count(*) AS total_rows, count(DISTINCT CAST(l_orderkey AS VARCHAR) || '|' || CAST(line AS VARCHAR)) AS distinct_keys, count(*) - count(DISTINCT CAST(l_orderkey AS VARCHAR) || '|' || CAST(line AS VARCHAR)) AS duplicate_count,
count(l_orderkey) AS non_null_l_orderkey, count(line) AS non_null_line FROM l GROUP BY 1""")
def uniqueness_composite(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.trunc(F.to_date("l_shipdate"), "MM").alias("period"), "l_orderkey", F.when(F.col("l_partkey") % 50 != 0, F.col("l_linenumber")).alias("line"))  # noqa: E741
    return H.uniqueness(l, ["l_orderkey", "line"])


PROFILE_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _profiled(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(*PROFILE_COLUMNS, "o_orderdate", F.col("o_custkey").cast("string").alias("cust_text"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("rare_status"))
    return P.column_stats(o, exact=True)


PROFILE_SQL = "WITH o AS (SELECT *, CAST(o_custkey AS VARCHAR) AS cust_text, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS rare_status FROM orders), st AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS kind, count(*) AS total_count, count({c}) AS non_null_count, count(DISTINCT {c}) AS distinct_count, CAST({f'count(TRY_CAST({c} AS DOUBLE))' if k == 'string' else '0'} AS BIGINT) AS castable_count FROM o"
    for c, k in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string"), ("cust_text", "string"), ("rare_status", "string"))
) + " UNION ALL SELECT 'o_orderdate', 'day', count(*), NULL, NULL, NULL FROM o)"

CLASS_SQL = PROFILE_SQL + """, r AS (SELECT *, CASE WHEN non_null_count > 0 THEN distinct_count / non_null_count ELSE 0 END AS ratio, CASE WHEN non_null_count > 0 THEN castable_count / non_null_count ELSE 0 END AS cast_ratio FROM st),
c AS (SELECT *, CASE WHEN kind IN ('bigint', 'double') THEN 'NUMERIC' WHEN kind = 'day' THEN 'DATETIME' WHEN non_null_count = 0 THEN 'UNKNOWN'
 WHEN castable_count > 0 AND cast_ratio >= 0.95 AND distinct_count >= 10000 AND ratio >= 0.5 THEN 'IDENTIFIER' WHEN castable_count > 0 AND cast_ratio >= 0.95 AND distinct_count <= 20 THEN 'CATEGORICAL_LOW'
 WHEN castable_count > 0 AND cast_ratio >= 0.95 THEN 'NUMERIC' WHEN distinct_count <= 50 AND ratio < 0.005 THEN 'CATEGORICAL_LOW' WHEN distinct_count <= 500 AND ratio < 0.05 THEN 'CATEGORICAL_MID' ELSE 'CATEGORICAL_HIGH' END AS inferred_type,
 CASE WHEN kind IN ('bigint', 'double') AND non_null_count > 0 AND distinct_count BETWEEN 1 AND 20 THEN 'CATEGORICAL_LOW' WHEN kind = 'bigint' AND non_null_count > 0 AND distinct_count >= 10000 AND ratio >= 0.5 THEN 'IDENTIFIER' END AS suggested_type FROM r)"""


@query(PROFILE_SQL + " SELECT column_name, total_count, non_null_count, distinct_count, castable_count FROM st")
def column_profile_batch(spark, sf_dir):
    return _profiled(spark, sf_dir).select("column_name", "total_count", "non_null_count", "distinct_count", "castable_count")


@query()
def column_profile_approx(spark, sf_dir):
    return P.classified(P.column_stats(table(spark, sf_dir, "lineitem")))


@query("SELECT count(*) AS n, count(TRY_CAST(t AS DOUBLE)) AS castable FROM (SELECT CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS t FROM events) q")
def castability(spark, sf_dir):
    t = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(P.castable(t)).alias("castable"))


@query(CLASS_SQL + " SELECT column_name, inferred_type, coalesce(suggested_type, inferred_type) AS semantic_type, round(coalesce(ratio, 0), 6) AS distinct_ratio, round(coalesce(cast_ratio, 0), 6) AS numeric_cast_ratio FROM c")
def semantic_types(spark, sf_dir):
    return rounded(P.classified(_profiled(spark, sf_dir)).select("column_name", "inferred_type", "semantic_type", "distinct_ratio", "numeric_cast_ratio"))


@query(CLASS_SQL + " SELECT column_name, suggested_type FROM c WHERE suggested_type IS NOT NULL")
def reclassification(spark, sf_dir):
    return P.classified(_profiled(spark, sf_dir)).where("suggested_type IS NOT NULL").select("column_name", "suggested_type")


@query(CLASS_SQL + """ SELECT column_name, semantic_type, CASE semantic_type WHEN 'DATETIME' THEN 'time axis' WHEN 'IDENTIFIER' THEN 'identifier' WHEN 'UNKNOWN' THEN 'unknown content' WHEN 'CATEGORICAL_HIGH' THEN 'too many categories' ELSE 'too many nulls' END AS reason
FROM (SELECT *, coalesce(suggested_type, inferred_type) AS semantic_type FROM c) q WHERE semantic_type IN ('DATETIME', 'IDENTIFIER', 'UNKNOWN', 'CATEGORICAL_HIGH') OR non_null_count < 0.9 * total_count""")
def column_exclusions(spark, sf_dir):
    return P.excluded(P.classified(_profiled(spark, sf_dir)))


@query("""SELECT 'd' AS column_name, CASE WHEN regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'yyyy-MM-dd' WHEN regexp_matches(d, '^\\d{8}$') THEN 'yyyyMMdd' ELSE 'none' END AS format, count(*) AS votes
FROM (SELECT DISTINCT CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) q GROUP BY 1, 2""")
def date_format_detect(spark, sf_dir):
    k = F.col("o_orderkey")
    d = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 97 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return dates.format_votes(table(spark, sf_dir, "orders").select(d.alias("d")), "d")


@query("""WITH p(population) AS (SELECT count(*) FROM lineitem UNION ALL SELECT 100 * count(*) FROM lineitem UNION ALL SELECT 100000 * count(*) FROM lineitem),
n AS (SELECT population, 0.25 * power(1.96 / 0.05, 2) AS n0 FROM p), a AS (SELECT population, CAST(greatest(1, ceil(n0 / (1 + (n0 - 1) / population))) AS BIGINT) AS sample_size FROM n)
SELECT CAST(population AS BIGINT) AS population, sample_size, CASE WHEN population >= 50000 AND 100.0 * sample_size / population <= 50 THEN round(least(greatest(100.0 * sample_size / population, 0.1), 100.0 * 500000 / population), 4) END AS sample_pct FROM a""")
def sample_size(spark, sf_dir):
    n = catalog.volume(table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(p, sampling.sample_size(p), sampling.sample_pct(p)) for p in (n, 100 * n, 100_000 * n)], "population long, sample_size long, sample_pct double")
