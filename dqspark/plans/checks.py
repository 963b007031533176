"""Rules, logs, sessions and sinks whose inputs are made from tables, each with SQL over the same tables.

Nations name the columns of made-up rules: N<key>, with figures that follow from the key.
"""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import functions as F

from ..functions import guards
from ..operators import export as X
from ..operators import history as H
from ..operators import profile as P
from ..operators import proposals as PR
from ..operators import regime as R
from ..operators import results as RS
from ..operators import strategies as ST
from ..operators import tune as T
from ..rules import evaluate as E
from ..rules import explain, ir, render
from ..rules.ir import Guard, Rule
from ..sources import catalog, writer
from ..sources.session import Presets, QuerySession, cost, timeout_for
from ..sources.spec import SourceSpec
from . import analytics as A
from . import base as B
from . import tuning
from .histories import CLASS_SQL, _profiled
from .registry import query, rounded, table
from .ruleplans import _one, _one_sql


def _keys(spark, sf_dir) -> list[int]:
    return sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())


# sources and sinks


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def sql_frame(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return QuerySession(spark).frame("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM {o} WHERE o_orderstatus = 'F' GROUP BY 1", "by priority", o=o)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def sql_rows(spark, sf_dir):
    s = QuerySession(spark)
    rows = s.collect(s.frame("SELECT event_type, count(*) AS n FROM {e} GROUP BY 1", e=table(spark, sf_dir, "events")), "types", "events")
    return spark.createDataFrame([tuple(r) for r in rows], "event_type string, n long")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def partitioned_write(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", "event_type", F.to_date("ts").alias("day"))
    back = writer.write_partitioned(e, writer.shared_path(spark, "events"), ["day", "event_type"])
    return back.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _events_table(spark, sf_dir, name: str):
    e = table(spark, sf_dir, "events").select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return writer.as_table(e, name, writer.shared_path(spark, name), ["day"])


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS value FROM events")
def partition_values_catalog(spark, sf_dir):
    _events_table(spark, sf_dir, "dq_events_values")
    return catalog.partition_values(spark, "dq_events_values", "day")


@query("SELECT CAST(min(ts) AS DATE) AS min_period, CAST(max(ts) AS DATE) AS max_period, count(DISTINCT CAST(ts AS DATE)) AS n_periods FROM events")
def partition_range_catalog(spark, sf_dir):
    _events_table(spark, sf_dir, "dq_events_range")
    return catalog.partition_range(spark, "dq_events_range", "day")


@query("SELECT 0 AS position, 'event_id' AS column_name, false AS is_partition, true AS there, true AS healthy, false AS other FROM events HAVING count(*) > 0 UNION ALL SELECT 1, 'value', false, true, true, false UNION ALL SELECT 2, 'day', true, true, true, false")
def catalog_probe(spark, sf_dir):
    _events_table(spark, sf_dir, "dq_events_probe")
    rows = [(c["position"], c["name"], c["is_partition"], catalog.exists(spark, "dq_events_probe"), catalog.healthy(spark), catalog.exists(spark, "dq_no_such_table")) for c in catalog.columns(spark, "dq_events_probe")]
    return spark.createDataFrame(rows, "position int, column_name string, is_partition boolean, there boolean, healthy boolean, other boolean")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, CAST(row_number() OVER () - 1 AS INTEGER) AS position FROM (DESCRIBE {t})" for t in TABLES))
def column_discovery_tables(spark, sf_dir):
    out = None
    for t in TABLES:
        c = catalog.column_table(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "column_name", "position")
        out = c if out is None else out.unionByName(c)
    return out


@query("SELECT CAST(l_shipdate AS DATE) AS period, count(*) AS row_count FROM (SELECT *, l_shipdate + to_days(CAST(l_linenumber AS INTEGER)) AS business FROM lineitem) q WHERE CAST(l_shipdate AS DATE) >= DATE '2001-05-03' AND CAST(business AS DATE) >= DATE '2001-05-03' AND l_quantity > 5 GROUP BY 1")
def business_date_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("business", F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber")))
    spec = SourceSpec("lineitem", date_column="l_shipdate", business_date="business", base_filter="l_quantity > 5", lookback=185, reference_day=B.SHIP_DAY)
    return H.row_count(spec.resolve(spark, rows))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 3 GROUP BY 1")
def equality_filters(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("seventh", F.col("o_custkey") % 7)
    return o.where(guards.equals("o_orderstatus", "F") & F.expr(guards.equals_text("seventh", " 3 ", numeric=True))).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def _allowed(check, text) -> bool:
    try:
        check(text)
        return True
    except guards.UnsafeText:
        return False


WORDS = ("ALTER", "CREATE", "DELETE", "DROP", "EXEC", "GRANT", "INSERT", "MERGE", "REVOKE", "SELECT", "TRUNCATE", "UNION", "UPDATE", "EXECUTED", "--", "/*", ";", "(", "")


@query(f"""WITH w AS (SELECT n_nationkey AS k, n_name, list_extract([{', '.join(f"'{w}'" for w in WORDS)}], CAST(n_nationkey % {len(WORDS)} + 1 AS INTEGER)) AS w FROM nation)
SELECT k, regexp_full_match(n_name, '[a-zA-Z_][a-zA-Z0-9_]*') AS is_name, w IN ('EXECUTED', '') AS is_filter, w = '' AS is_day FROM w""")
def guard_verdicts(spark, sf_dir):
    rows = []
    for r in sorted(table(spark, sf_dir, "nation").collect()):
        w = WORDS[r["n_nationkey"] % len(WORDS)]
        text = f"{r['n_name']} = 1" + (f" AND {w.lower()} = 2" if w.isalpha() else f" {w}")
        rows.append((r["n_nationkey"], _allowed(guards.identifier, r["n_name"]), _allowed(guards.filter_text, text), _allowed(guards.reference_day, "2024-01-05" if w == "" else f"2024-01-05 {w}")))
    return spark.createDataFrame(rows, "k int, is_name boolean, is_filter boolean, is_day boolean")


@query("SELECT DISTINCT o_orderpriority AS value FROM orders")
def distinct_values_head(spark, sf_dir):
    """The five priorities that there are."""
    return catalog.sample_values(table(spark, sf_dir, "orders"), "o_orderpriority", 5)


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def bernoulli_sample(spark, sf_dir):
    """Whether a fifth of each type's rows is sampled, within five standard deviations."""
    spec = SourceSpec("events", date_column="ts", lookback=30, reference_day=B.EVENT_DAY, sample_pct=20.0)
    e = table(spark, sf_dir, "events")
    part = spec.resolve(spark, e, sampled=True).groupBy("event_type").agg(F.count("*").alias("k"))
    whole = spec.resolve(spark, e).groupBy("event_type").agg(F.count("*").alias("n"))
    return whole.join(part, "event_type").select("event_type", (F.abs(F.col("k") - 0.2 * F.col("n")) <= 5 * F.sqrt(0.16 * F.col("n"))).alias("near"))


@query("SELECT CAST(ts AS DATE) AS period, count(*) AS total_count, true AS near FROM events GROUP BY 1")
def distinct_sketch_error(spark, sf_dir):
    """Whether sketches of distinct users are within ten per cent of the exact counts."""
    e = B.events(spark, sf_dir)
    exact = H.distinct_counts(e, "user_id", exact=True).select("period", F.col("distinct_count").alias("d"))
    return H.distinct_counts(e, "user_id").join(exact, "period").select("period", "total_count", (F.abs(F.col("distinct_count") - F.col("d")) <= 0.1 * F.col("d") + 1).alias("near"))


@query("SELECT CAST(ts AS DATE) AS period, count(*) AS total_count, true AS near FROM events GROUP BY 1")
def quantile_sketch_error(spark, sf_dir):
    """Whether the ranks of sketched quantiles are off by a row and three per cent of the rows at most."""
    e = B.events(spark, sf_dir)
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    h = H.numeric(e, "v").select("period", "total_count", "non_null_count", *shares)
    counts = [c for n in shares for c in (F.count_if(F.col("v") < F.col(n)).alias(f"{n}_below"), F.count_if(F.col("v") <= F.col(n)).alias(f"{n}_upto"))]
    g = e.select("period", "v").join(h, "period").groupBy("period", "total_count", "non_null_count").agg(*counts)
    near, slack = F.lit(True), 1 + 0.03 * F.col("non_null_count")
    for n, q in shares.items():
        rank = q * F.col("non_null_count")
        near = near & (F.col(f"{n}_below") <= rank + slack) & (F.col(f"{n}_upto") >= rank - slack)
    return g.select("period", "total_count", near.alias("near"))


@query("SELECT 'one' AS name, false AS cached, count(*) AS \"rows\" FROM region UNION ALL SELECT 'one', true, count(*) FROM region UNION ALL SELECT 'two', false, count(*) FROM nation")
def result_cache(spark, sf_dir):
    s = QuerySession(spark)
    spec = SourceSpec("region", date_column="r_name")
    for _ in range(2):
        s.cached(spec.fingerprint(), "metadata", table(spark, sf_dir, "region"), "one")
    s.cached(spec.fingerprint() + "n", "history", table(spark, sf_dir, "nation"), "two")
    return s.log().select("name", "cached", "rows")


@query("SELECT 'a' AS name, 'ok' AS status, count(*) AS \"rows\" FROM region UNION ALL SELECT 'b', 'ok', count(*) FROM nation")
def query_log_sink(spark, sf_dir):
    s = QuerySession(spark)
    s.collect(table(spark, sf_dir, "region"), "a")
    s.collect(table(spark, sf_dir, "nation"), "b")
    s.save_log(path := writer.shared_path(spark, "log"))
    return X.newest(spark.read.json(path), 20, status="ok").select("name", "status", "rows")


@query("SELECT n_nationkey AS k, CAST(round(greatest(n_nationkey * 4000000, 10000000) / 1e12 * CASE WHEN n_regionkey = 0 THEN 9.0 ELSE 5.0 END * 1e9) AS BIGINT) AS nano_usd, CASE WHEN n_nationkey * 25000000 >= 500000000 THEN 600 WHEN n_nationkey * 25000000 >= 100000000 THEN 360 WHEN n_nationkey * 25000000 >= 10000000 THEN 240 ELSE 120 END AS timeout FROM nation")
def query_costs(spark, sf_dir):
    rows = [(r["n_nationkey"], round(cost(r["n_nationkey"] * 4_000_000, "sa-east-1" if r["n_regionkey"] == 0 else "") * 1e9), timeout_for(r["n_nationkey"] * 25_000_000)) for r in table(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame(rows, "k int, nano_usd long, timeout int")


@query("SELECT 'rows' AS field, CAST(count(*) AS VARCHAR) AS a, CAST(count(*) + 1 AS VARCHAR) AS b FROM orders")
def preset_compare(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    with tempfile.TemporaryDirectory() as folder:  # the driver's own configuration files
        p = Presets(folder)
        p.save("a", {"rows": n, "table": "orders"})
        p.clone("a", "c")
        p.save("b", {"rows": n + 1, "table": "orders"})
        found = p.compare("c", "b")
    return spark.createDataFrame([(k, str(x), str(y)) for k, (x, y) in found.items()], "field string, a string, b string")


# rule text


def _numbered(k: int) -> dict[str, Rule]:
    name, g = f"n{k}", Guard(10 + k, 2.0 + 0.5 * (k % 2), 0.05 * (k % 4 + 1))
    hybrid = Guard(10 + k, 2.0, 0.10, True, 0.01, float(k), 50.0 + k)
    return {
        ir.MEAN: Rule(ir.MEAN, name, g), ir.STDDEV: Rule(ir.STDDEV, name, g), ir.COMPLETENESS: Rule(ir.COMPLETENESS, name, lower=(70 + k) / 100), ir.ALLOWED: Rule(ir.ALLOWED, name, values=(f"v{k}", str(k), "null")),
        ir.DISTINCT: Rule(ir.DISTINCT, name, lower=k), ir.DISTINCT_RANGE: Rule(ir.DISTINCT_RANGE, name, lower=k, upper=2 * k), ir.PRIMARY_KEY: Rule(ir.PRIMARY_KEY, values=(name, f"m{k}")), ir.FREQ_STATIC: Rule(ir.FREQ_STATIC, name, lower=k / 2, upper=k + 1.5, category=f"v{k}"),
        ir.FREQ_DYNAMIC: Rule(ir.FREQ_DYNAMIC, name, g, category=f"v{k}"), ir.FREQ_HYBRID: Rule(ir.FREQ_HYBRID, name, hybrid, category=f"v{k}"), ir.PERCENTILE: Rule(ir.PERCENTILE, name, Guard(10 + k, 3.0, 0.10, False), values=("0.90",)), ir.ROW_COUNT: Rule(ir.ROW_COUNT, None, g),
    }


#: Pieces of rule text by nation: window, sigma, factors, and the dual guards around a subject.
PIECES = """WITH k AS (SELECT n_nationkey AS k, 'N' || n_nationkey AS n, CAST(10 + n_nationkey AS VARCHAR) AS w, CASE WHEN n_nationkey % 2 = 1 THEN '2.5' ELSE '2' END AS s, CASE WHEN n_nationkey % 2 = 1 THEN '2.5' ELSE '2.0' END AS sf,
 list_extract(['0.95', '0.9', '0.85', '0.8'], CAST(n_nationkey % 4 + 1 AS INTEGER)) AS lo, list_extract(['1.05', '1.1', '1.15', '1.2'], CAST(n_nationkey % 4 + 1 AS INTEGER)) AS hi, list_extract(['0.05', '0.1', '0.15000000000000002', '0.2'], CAST(n_nationkey % 4 + 1 AS INTEGER)) AS mg FROM nation),
f AS (SELECT *, 'avg(last(' || w || '))' AS m, 'std(last(' || w || '))' AS d FROM k)"""


def _where(sql: str, where: str) -> str:
    return f"CustomSql \"select {sql} from primary{where}\""


def _dual(subject: str, margin: str = "ON", s: str = "s", lo: str = "lo", hi: str = "hi") -> str:
    sigma = f"'((' || {subject} || ' >= (' || m || ' - (' || {s} || ' * ' || d || ') - 0.01)) AND (' || {subject} || ' <= (' || m || ' + (' || {s} || ' * ' || d || ') + 0.01)))'"
    if margin == "OFF":
        return sigma
    left, right = ("'(' || m || ' * ' || " + x + " || ')" for x in (lo, hi))
    if margin == "SQL":
        band = f"'((' || {subject} || ' >= (' || m || ' * ' || {lo} || ' - 0.01)) AND (' || {subject} || ' <= (' || m || ' * ' || {hi} || ' + 0.01)))'"
    else:
        band = f"'((' || {subject} || ' >= ' || {left} - 0.01) AND (' || {subject} || ' <= ' || {right} + 0.01))'"
    return f"'(' || {sigma} || ' OR ' || {band} || ')'"


def _texts_sql(where: str = "") -> str:
    """SQL for the text of every numbered rule, plain or under a condition."""
    t = lambda sql: "'CustomSql \"select ' || " + sql + f" || ' from primary{where}\"'"
    freq = t("'cast(sum(case when ' || n || ' = ''v' || k || ''' then 1 else 0 end) as double) * 100.0 / count(*)'")
    pct = t("'approx_percentile(cast(' || n || ' as double), 0.90)'")
    rows = {
        ir.FREQ_STATIC: f"'(' || {freq} || ' >= ' || printf('%.4f', k / 2) || ') AND (' || {freq} || ' <= ' || printf('%.4f', k + 1.5) || ')'",
        ir.FREQ_DYNAMIC: _dual(freq, "SQL"),
        ir.FREQ_HYBRID: f"'(' || {_dual(freq, 'SQL', chr(39) + '2' + chr(39), chr(39) + '0.9' + chr(39), chr(39) + '1.1' + chr(39))} || ' AND ((' || {freq} || ' >= ' || printf('%.4f', k + 0.0) || ') AND (' || {freq} || ' <= ' || printf('%.4f', 50.0 + k) || ')))'",
        ir.PERCENTILE: _dual(pct, "OFF", "'3'"),
    }
    if where:
        rows |= {
            ir.MEAN: _dual(t("'avg(cast(' || n || ' as double))'"), "SQL"), ir.STDDEV: _dual(t("'stddev(cast(' || n || ' as double))'"), "SQL"), ir.ROW_COUNT: _dual(t("'cast(count(*) as double)'"), "SQL").replace(" - 0.01)", " - 0)").replace(" + 0.01)", " + 0)"),
            ir.COMPLETENESS: t("'cast(count(' || n || ') as double) / nullif(count(*), 0)'") + " || ' >= ' || printf('%.2f', (70 + k) / 100)", ir.ALLOWED: t("'cast(count(case when cast(' || n || ' as varchar) not in (''v' || k || ''', ''' || k || ''') then 1 end) as double)'") + " || ' = 0'",
            ir.DISTINCT: t("'cast(count(distinct ' || n || ') as double)'") + " || ' = ' || k", ir.PRIMARY_KEY: "NULL",
            ir.DISTINCT_RANGE: "'(' || " + t("'cast(count(distinct ' || n || ') as double)'") + " || ' >= ' || k || ') AND (' || " + t("'cast(count(distinct ' || n || ') as double)'") + " || ' <= ' || 2 * k || ')'",
        }
    else:
        reach = "'(' || sf || ' * ' || d || ')'"
        rows |= {
            ir.MEAN: _dual("'Mean ' || n"), ir.STDDEV: _dual("'StandardDeviation ' || n"), ir.COMPLETENESS: "'Completeness ' || n || ' >= ' || printf('%.2f', (70 + k) / 100)", ir.ALLOWED: "'ColumnValues ' || n || ' in [\"v' || k || '\", ' || k || ', NULL]'",
            ir.DISTINCT: "'DistinctValuesCount ' || n || ' = ' || k", ir.DISTINCT_RANGE: "'(DistinctValuesCount ' || n || ' >= ' || k || ') AND (DistinctValuesCount ' || n || ' <= ' || 2 * k || ')'", ir.PRIMARY_KEY: "'IsPrimaryKey ' || n || ' M' || k",
            ir.ROW_COUNT: f"'(((RowCount >= (' || m || ' * 1.0 - ' || {reach} || ')) AND (RowCount <= (' || m || ' * 1.0 + ' || {reach} || '))) OR ((RowCount >= (' || m || ' - (' || m || ' * ' || mg || '))) AND (RowCount <= (' || m || ' + (' || m || ' * ' || mg || ')))))'",
        }
    return PIECES + " " + " UNION ALL ".join(f"SELECT k, '{kind}' AS rule_type, {text} AS rule FROM f" for kind, text in rows.items())


@query(_texts_sql())
def rule_text_numbered(spark, sf_dir):
    return spark.createDataFrame([(k, kind, render.render(r)) for k in _keys(spark, sf_dir) for kind, r in _numbered(k).items()], "k int, rule_type string, rule string")


@query(_texts_sql(" where d = 7 and e = ''x''"))
def rule_text_numbered_where(spark, sf_dir):
    return spark.createDataFrame([(k, kind, render.render_where(r, "d = 7 and e = 'x'")) for k in _keys(spark, sf_dir) for kind, r in _numbered(k).items()], "k int, rule_type string, rule string")


@query("""SELECT n_nationkey AS k, 'the share of filled values of n' || n_nationkey || ' is at least ' || (70 + n_nationkey) || '%' AS completeness, 'the number of distinct values of n' || n_nationkey || ' is ' || n_nationkey AS distinct_count,
'the mean of n' || n_nationkey || ' stays within ' || CASE WHEN n_nationkey % 2 = 1 THEN '2.50' ELSE '2' END || ' standard deviations of its mean over the last ' || (10 + n_nationkey) || ' runs, or within ' || (5 * (n_nationkey % 4 + 1)) || '% of it' AS mean,
CASE WHEN n_nationkey = 0 THEN 'no period in the window: check the reference day, the filters and the date format' WHEN n_nationkey < 7 THEN n_nationkey || ' periods, 7 are needed: look back further' END AS gap,
'only the month' || CASE WHEN n_nationkey = 0 THEN '' ELSE ' ' || n_nationkey || ' before the current one is checked' END AS date_filter, 'Passed: Column.N.Mean = ' || (n_nationkey + 1) || '; expected ' || n_nationkey || ' to ' || (2 * n_nationkey + 1) AS result FROM nation""")
def explanations(spark, sf_dir):
    rows = []
    for k in _keys(spark, sf_dir):
        r = _numbered(k)
        said = explain.date_condition("MONTH", "LAG_N", k)
        rows.append((k, explain.rule(r[ir.COMPLETENESS]), explain.rule(r[ir.DISTINCT]), explain.rule(r[ir.MEAN]), explain.history_gap(k, 7), said if k else "only the month", explain.result({"outcome": "Passed", "metrics": {"Column.N.Mean": k + 1.0}, "lower_bound": float(k), "upper_bound": 2.0 * k + 1})))
    return spark.createDataFrame(rows, "k int, completeness string, distinct_count string, mean string, gap string, date_filter string, result string")


# names, columns, sessions of rules


_SHOWN = ("id_", "sk_", "_sk", "cpf_", "dt_", "_dt", "ind_", "fl_", "vlr_", "_saldo", "qtde_", "aliq_", "tp_", "_tipo", "uf", "nom_", "_obs", "x_", "valx", "num_doc")
_HINTED = ("identifier",) * 4 + ("date", "date", "flag", "flag", "amount", "amount", "quantity", "percentage", "code", "code", "code", "text", "text", None, None, "identifier")


@query(f"""WITH p AS (SELECT unnest([{', '.join(f"'{x}'" for x in _SHOWN)}]) AS x, unnest([{', '.join('NULL' if h is None else f"'{h}'" for h in _HINTED)}]) AS strongest)
SELECT CASE WHEN left(x, 1) = '_' THEN 'Col' || n_nationkey || x ELSE upper(x) || n_nationkey END AS column_name, strongest FROM p, nation""")
def name_hints_made(spark, sf_dir):
    """Nations' keys under every kind of beginning and end."""
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    x = k.select("k", F.explode(F.array(*map(F.lit, _SHOWN))).alias("x"))
    names = x.select(F.when(F.col("x").startswith("_"), F.concat(F.lit("Col"), "k", "x")).otherwise(F.concat(F.upper("x"), "k")).alias("column_name"))
    return P.name_hints(names).select("column_name", "strongest")


@query("SELECT table_name, column_name, CASE WHEN column_name LIKE '%\\_id' ESCAPE '\\' THEN 'identifier' END AS strongest FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE {t})" for t in TABLES) + ") q")
def name_hints_tables(spark, sf_dir):
    out = None
    for t in TABLES:
        c = P.name_hints(catalog.column_table(table(spark, sf_dir, t))).select(F.lit(t).alias("table_name"), "column_name", "strongest")
        out = c if out is None else out.unionByName(c)
    return out


@query(CLASS_SQL + " SELECT column_name, CASE column_name WHEN 'o_custkey' THEN 'IDENTIFIER' WHEN 'cust_text' THEN 'FREE_TEXT' ELSE coalesce(suggested_type, inferred_type) END AS semantic_type FROM c")
def type_overrides(spark, sf_dir):
    return P.classified(_profiled(spark, sf_dir), {"o_custkey": "IDENTIFIER", "cust_text": "FREE_TEXT"}).select("column_name", "semantic_type")


def _cart(spark, sf_dir):
    rows = []
    for k in _keys(spark, sf_dir):
        r = _numbered(k)
        rows += [(3 * k, k % 5 != 0, ir.COMPLETENESS, f"n{k}", [], render.render(r[ir.COMPLETENESS]), None), (3 * k + 1, True, ir.PRIMARY_KEY, None, [f"n{k}", f"m{k}"], render.render(r[ir.PRIMARY_KEY]), None), (3 * k + 2, k % 2 == 0, ir.DISTINCT, f"n{k}", [], render.render(r[ir.DISTINCT]), f"(seg{k % 3} = 'x')")]
    return spark.createDataFrame(rows, "position int, enabled boolean, rule_type string, column_name string, values array<string>, rule string, condition string")


@query("SELECT 'Completeness N' || n_nationkey || ' >= ' || printf('%.2f', (70 + n_nationkey) / 100) AS rule FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'IsPrimaryKey N' || n_nationkey || ' M' || n_nationkey FROM nation UNION ALL SELECT 'DistinctValuesCount N' || n_nationkey || ' = ' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def rules_sink(spark, sf_dir):
    X.write_rules(_cart(spark, sf_dir), path := writer.shared_path(spark, "rules"))
    return spark.read.text(path).select(F.col("value").alias("rule"))


@query("SELECT 'N' || n_nationkey AS column_name FROM nation UNION SELECT 'M' || n_nationkey FROM nation UNION SELECT 'SEG' || n_nationkey % 3 FROM nation WHERE n_nationkey % 2 = 0")
def rule_columns(spark, sf_dir):
    return X.rule_columns(_cart(spark, sf_dir))


@query("WITH r AS (SELECT 3 * n_nationkey AS p, 'Completeness N' || n_nationkey || ' >= ' || printf('%.2f', (70 + n_nationkey) / 100) AS rule FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 3 * n_nationkey + 1, 'IsPrimaryKey N' || n_nationkey || ' M' || n_nationkey FROM nation UNION ALL SELECT 3 * n_nationkey + 2, 'DistinctValuesCount N' || n_nationkey || ' = ' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT 'N' || n_nationkey AS c FROM nation UNION SELECT 'M' || n_nationkey FROM nation UNION SELECT 'SEG' || n_nationkey % 3 FROM nation WHERE n_nationkey % 2 = 0) SELECT 'T' AS dataset, (SELECT string_agg(rule, chr(10) ORDER BY p) FROM r) AS rules, (SELECT string_agg(c, ',' ORDER BY c) FROM c) AS columns")
def job_payload(spark, sf_dir):
    found = json.loads(X.payload(_cart(spark, sf_dir), "T", ["p"]))
    return spark.createDataFrame([(found["TABELA"], "\n".join(r["RegraGDQ"] for r in found["VARIAVEIS"]["GDQ"]), ",".join(found["COLUNAS"]))], "dataset string, rules string, columns string")


@query("SELECT n_nationkey AS k, substr(sha256('DistinctValuesCount N' || n_nationkey || ' = ' || n_nationkey), 1, 16) AS h, n_nationkey % 3 = 0 AS is_stale FROM nation")
def stale_results(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat_ws("", F.lit("DistinctValuesCount N"), "n_nationkey", F.lit(" = "), "n_nationkey").alias("rule"))
    n = n.withColumn("tested_hash", RS.syntax_hash(F.when(F.col("k") % 3 == 0, F.concat("rule", F.lit("0"))).otherwise(F.col("rule"))))
    old = RS.stale(n).select(F.col("k").alias("old"))
    return n.join(old, n["k"] == old["old"], "left").select("k", RS.syntax_hash(F.col("rule")).alias("h"), F.col("old").isNotNull().alias("is_stale"))


def _log(spark, sf_dir):
    """One job log with three results per nation: two in the marked list, one saved alone."""
    listed, saved = [], []
    for k in _keys(spark, sf_dir):
        listed += [f"{{'rule': 'Completeness N{k} >= 0.{70 + k}', 'outcome': 'Passed', 'evaluatedmetrics': {{'Column.N{k}.Completeness': 0.5}}, 'failurereason': None}}"]
        listed += [f"{{'rule': 'Mean N{k} between 1 and {k + 2} [x]', 'outcome': 'Failed', 'evaluatedmetrics': '{{\"Column.N{k}.Mean\": \"{k}.5\"}}', 'failurereason': 'Value: {k}.5\\nExpectedRange: [1.0, {k + 2}.0]'}}"]
        saved += [f"INFO:BookQualidades:Salvando {{'Rule': 'RowCount >= {k}', 'Outcome': 'Passed', 'EvaluatedMetrics': {{'Dataset.*.RowCount': {1000 + k}}}, 'FailureReason': '', 'EvaluatedRule': 'RowCount between {k} and {10 * k + 5}'}}"]
    text = "2026-01-01T00:00:00Z INFO:Dist:start\nINFO:Dist:Resultados GDQ:\nINFO:Dist:[" + ", ".join(listed) + "]\n" + "\n".join(saved)
    return spark.createDataFrame([("log", text)], "log_id string, text string")


@query("""SELECT 2 * n_nationkey AS "position", 'Completeness N' || n_nationkey || ' >= 0.' || (70 + n_nationkey) AS rule, 'Passed' AS outcome, 'Completeness' AS category, 'N' || n_nationkey AS target_column, NULL::DOUBLE AS compiled_lower, NULL::DOUBLE AS compiled_upper, 0.5::DOUBLE AS metric FROM nation
UNION ALL SELECT 2 * n_nationkey + 1, 'Mean N' || n_nationkey || ' between 1 and ' || (n_nationkey + 2) || ' [x]', 'Failed', 'Mean', 'N' || n_nationkey, 1.0, n_nationkey + 2, n_nationkey + 0.5 FROM nation
UNION ALL SELECT 2 * (SELECT count(*) FROM nation) + n_nationkey, 'RowCount >= ' || n_nationkey, 'Passed', 'RowCount', '', n_nationkey, 10 * n_nationkey + 5, 1000 + n_nationkey FROM nation""")
def log_parse_numbered(spark, sf_dir):
    return RS.from_logs(_log(spark, sf_dir)).select("position", "rule", "outcome", "category", "target_column", "compiled_lower", "compiled_upper", F.map_values("metrics")[0].alias("metric"))


def _sent(spark, sf_dir):
    """Rules as sent: completeness with other white space, means with other text, row counts whose text fits for even keys only."""
    rows = []
    for k in _keys(spark, sf_dir):
        rows += [(f"c{k}", ir.COMPLETENESS, f"N{k}", f"Completeness  N{k}   >= 0.{70 + k}"), (f"m{k}", ir.MEAN, f"n{k}", f"Mean N{k} >= 1"), (f"r{k}", ir.ROW_COUNT, None, f"RowCount >= {k}" if k % 2 == 0 else f"RowCount >= -{k}")]
    return spark.createDataFrame(rows, "proposal_id string, rule_type string, column_name string, rule string")


@query("""SELECT 'c' || n_nationkey AS proposal_id, 2 * n_nationkey AS "position", 'text' AS how FROM nation UNION ALL SELECT 'm' || n_nationkey, 2 * n_nationkey + 1, 'type and column' FROM nation
UNION ALL SELECT 'r' || n_nationkey, 2 * (SELECT count(*) FROM nation) + n_nationkey, 'text' FROM nation WHERE n_nationkey % 2 = 0""")
def correlate_numbered(spark, sf_dir):
    return RS.correlate(_sent(spark, sf_dir), RS.from_logs(_log(spark, sf_dir)))


@query("SELECT 2 * count(*) + count(*) FILTER (n_nationkey % 2 = 0) AS matched, count(*) FILTER (n_nationkey % 2 = 1) AS orphaned, count(*) FILTER (n_nationkey % 2 = 1) AS unmatched FROM nation")
def correlation_counts(spark, sf_dir):
    return RS.written_back(_sent(spark, sf_dir), RS.from_logs(_log(spark, sf_dir)), "2026-01-01")[1]


@query("""SELECT 'c' || n_nationkey AS proposal_id, 'Passed' AS outcome, '2026-01-01' AS tested_at FROM nation UNION ALL SELECT 'm' || n_nationkey, 'Failed', '2026-01-01' FROM nation UNION ALL SELECT 'r' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Passed' END, CASE WHEN n_nationkey % 2 = 0 THEN '2026-01-01' END FROM nation""")
def written_back(spark, sf_dir):
    return RS.written_back(_sent(spark, sf_dir), RS.from_logs(_log(spark, sf_dir)), "2026-01-01")[0].select("proposal_id", "outcome", "tested_at")


@query("""SELECT 'duplicate' AS "check", 'MEAN_DUAL_GUARD:' || 'n' || n_nationkey AS target FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'different windows', 'n' || n_nationkey FROM nation WHERE n_nationkey % 3 = 1
UNION ALL SELECT 'shares over 100 %', 'n' || n_nationkey FROM nation WHERE 8 * n_nationkey > 100 UNION ALL SELECT 'covered by the key', 'n' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT 'row count far from mean', min('n' || n_nationkey) FROM nation WHERE abs(30 - 10) > 15""")
def consistency_numbered(spark, sf_dir):
    rows = [(ir.ROW_COUNT, None, None, 10, None, None), (ir.PRIMARY_KEY, None, None, 30, None, [f"n{k}" for k in _keys(spark, sf_dir) if k % 4 == 0])]
    for k in _keys(spark, sf_dir):
        n = f"n{k}"
        rows += [(ir.MEAN, n, None, 30, None, None)] * (2 if k % 3 == 0 else 1) + ([(ir.STDDEV, n, None, 15, None, None)] if k % 3 == 1 else []) + [(ir.FREQ_STATIC, n, c, 30, 4.0 * k, None) for c in "xy"] + [(ir.COMPLETENESS, n, None, 30, None, None)]
    return X.inconsistencies(spark.createDataFrame(rows, "rule_type string, column_name string, category_value string, n int, upper double, values array<string>"))


@query("""WITH k AS (SELECT n_nationkey AS k, n_nationkey % 6 AS x FROM nation) SELECT k AS proposal_id, 'quoted column in a built-in rule' AS warning FROM k WHERE x = 0 UNION ALL SELECT k, 'functions of past runs are lower-case' FROM k WHERE x = 1 UNION ALL SELECT k, 'unbalanced brackets' FROM k WHERE x = 1
UNION ALL SELECT k, 'CustomSql without from primary' FROM k WHERE x = 2 UNION ALL SELECT k, 'Completeness takes a lower bound' FROM k WHERE x = 3 UNION ALL SELECT k, 'key columns are separated by spaces' FROM k WHERE x = 4""")
def syntax_numbered(spark, sf_dir):
    made = ('Mean "N{0}" >= 1', "Mean N{0} >= (AVG(last(3))", 'CustomSql "select {0}" >= 1', "Completeness N{0} between 0.1 and 0.2", "IsPrimaryKey N{0}, B", "RowCount >= {0}")
    return X.syntax_warnings(spark.createDataFrame([(k, made[k % 6].format(k)) for k in _keys(spark, sf_dir)], "proposal_id int, rule string"))


@query("""SELECT 'd' || n_nationkey AS proposal_id, 'AllowedValues' AS covered_by FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'c' || n_nationkey, 'IsPrimaryKey' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'p' || n_nationkey, 'Mean' FROM nation WHERE n_nationkey % 5 = 0""")
def redundancy_numbered(spark, sf_dir):
    ks, rows = _keys(spark, sf_dir), []
    for k in ks:
        n = f"n{k}"
        rows += [("d", n, ir.DISTINCT, 3.0, None), ("c", n, ir.COMPLETENESS, 1.0, None), ("m", n, ir.MEAN, None, None), ("p", n, ir.PERCENTILE, None, ["0.50" if k % 5 == 0 else "0.90"])] + ([("a", n, ir.ALLOWED, None, ["x"])] if k % 2 == 0 else [])
    rows.append(("k", None, ir.PRIMARY_KEY, None, [f"n{k}" for k in ks if k % 3 == 0]))
    p = spark.createDataFrame(rows, "i string, column_name string, rule_type string, lower double, values array<string>").select(F.concat("i", F.coalesce(F.substring("column_name", 2, 9), F.lit(""))).alias("proposal_id"), "column_name", "rule_type", "lower", F.coalesce("values", F.array().cast("array<string>")).alias("values"), F.lit("x").alias("metric_name"), F.lit("RECOMMENDED").alias("tier"), F.array().cast("array<string>").alias("reasons"))
    return PR.without_redundancy(p).where("covered_by IS NOT NULL").select("proposal_id", "covered_by")


# rules that are executed


@query(_one_sql("latest", "count(*) FILTER (o_orderdate = (SELECT max(o_orderdate) FROM orders))", "m >= 1", "orders", "1"))
def eval_latest_subquery(spark, sf_dir):
    where = render.date_condition("O_ORDERDATE", "DAY", "MAX_VALUE")
    return _one(spark, sf_dir, table(spark, sf_dir, "orders"), {"latest": f'CustomSql "select cast(count(*) as double) from primary where {where}" >= 1'})


@query("SELECT rule_id, CASE WHEN m >= 1 THEN 'Passed' ELSE 'Failed' END AS outcome, CAST(m AS DOUBLE) AS metric, CAST(1 AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule_id, count(*) FILTER (o_orderkey % 5 = {r}) AS m FROM orders" for n, r in (("day", 2), ("integer", 2), ("month", 3), ("year", 1), ("today", 0))) + ") q")
def eval_date_conditions(spark, sf_dir):
    """Orders dated so many days, months and years before today as their key modulo five says, and what each condition finds."""
    back = (F.col("o_orderkey") % 5).cast("int")
    o = table(spark, sf_dir, "orders").select(F.date_format(F.date_sub(F.current_date(), back), "yyyyMMdd").alias("D"), F.date_format(F.add_months(F.current_date(), -back), "yyyyMM").alias("M"), F.date_format(F.add_months(F.current_date(), -12 * back), "yyyy").alias("Y")).withColumn("I", F.col("D").cast("int"))
    d = render.date_condition
    where = {"day": d("D", "DAY", "LAG_N", 2), "integer": d("I", "DAY", "LAG_N", 2, True), "month": d("M", "MONTH", "LAG_N", 3), "year": d("Y", "YEAR", "LAG_N", 1), "today": d("D", "DAY")}
    return _one(spark, sf_dir, o, {k: f'CustomSql "select cast(count(*) as double) from primary where {w}" >= 1' for k, w in where.items()})


@query(_one_sql("outside", "count(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 END)", "m = 0", "orders WHERE o_orderpriority = '5-LOW'"))
def eval_out_of_domain(spark, sf_dir):
    rule = Rule(ir.ALLOWED, "o_orderstatus", values=("F", "O"))
    return _one(spark, sf_dir, table(spark, sf_dir, "orders"), {"outside": render.render_where(rule, "o_orderpriority = '5-LOW'")})


@query("SELECT 'p90' AS rule_id, CASE WHEN abs(m - 45) <= 1 THEN 'near' ELSE 'far' END AS metric FROM (SELECT quantile_disc(l_quantity, 0.9) AS m FROM lineitem) q")
def eval_percentile(spark, sf_dir):
    """The scalar percentile of a rule, which is a sketch: near the exact one or not."""
    out = E.evaluate(table(spark, sf_dir, "lineitem"), {"p90": 'CustomSql "select approx_percentile(cast(L_QUANTITY as double), 0.90) from primary" >= 1'})
    return out.select("rule_id", F.when(F.abs(F.map_values("metrics")[0] - 45) <= 1, "near").otherwise("far").alias("metric"))


# proposals


_MONTHS = "WITH RECURSIVE o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, * FROM orders)"
_SERIES = """s AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY period) - 1 AS INTEGER) AS idx, period, CAST(value AS DOUBLE) AS value FROM raw), ids AS (SELECT DISTINCT series_id FROM s),
valid AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS x, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS rn, count(*) OVER (PARTITION BY series_id) AS nv FROM s WHERE value IS NOT NULL)"""
_GUARDED = f"""bd AS (SELECT series_id, avg(value) AS m, coalesce(stddev_samp(value), 0.0) AS sd FROM valid WHERE rn <= 12 GROUP BY 1), {B.rolling(12)},
pt AS (SELECT *, {B.inside('value', '(m - 2 * sd)', '(m + 2 * sd)')} OR {B.inside('value', '(m - abs(m) * 0.1)', '(m + abs(m) * 0.1)')} AS passed FROM b WHERE value IS NOT NULL AND m IS NOT NULL), cv AS (SELECT series_id, count(*) FILTER (passed) / count(*) * 100 AS cov FROM pt GROUP BY 1)"""
_BOUNDS = "round(least(m - 2 * sd, m - abs(m) * 0.1), 5) AS lower, round(greatest(m + 2 * sd, m + abs(m) * 0.1), 5) AS upper, round(cov, 6) AS coverage_pct FROM bd JOIN cv USING (series_id)"


def _bounds(p, *columns):
    return p.select(*columns, F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"), F.round("coverage_pct", 6).alias("coverage_pct"))


@query(f"{_MONTHS}, raw AS (SELECT 'rows' AS series_id, period, count(*) AS value FROM o GROUP BY period), {_SERIES}, {_GUARDED} SELECT 'ROW_COUNT_DUAL_GUARD' AS rule_type, 'validated' AS capability, {_BOUNDS}")
def propose_row_count_strategy(spark, sf_dir):
    h = H.row_count(table(spark, sf_dir, "orders").withColumn("period", F.trunc(F.to_date("o_orderdate"), "MM")))
    p = ST.table_rules(h, tuning.GUARD).withColumn("capability", F.create_map(*[F.lit(x) for kv in ir.CAPABILITY.items() for x in kv])[F.col("rule_type")])
    return _bounds(p, "rule_type", "capability")


@query(f"{_MONTHS}, raw AS (" + " UNION ALL ".join(f"SELECT '{c}:{n}' AS series_id, period, quantile_cont({e}, {q}) AS value FROM o GROUP BY period" for c, e in (("o_totalprice", "o_totalprice"), ("o_custkey", "CASE WHEN o_orderkey % 25 <> 0 THEN o_custkey END")) for n, q in (("p10", 0.10), ("p90", 0.90)))
       + f"), {_SERIES}, {_GUARDED} SELECT split_part(series_id, ':', 1) AS column_name, split_part(series_id, ':', 2) AS metric_name, {_BOUNDS}")
def propose_percentile_bounds(spark, sf_dir):
    return _bounds(PR.percentiles(tuning._histories(spark, sf_dir), guard=tuning.GUARD), "column_name", "metric_name")


def _frequency_sql(kind: str, points: str) -> str:
    return f"""{A.SHARES}, {A._tail(10)}, {points}, cv AS (SELECT series_id, count(*) FILTER (passed) / count(*) * 100 AS cov FROM pt GROUP BY 1)
SELECT '{kind}' AS rule_type, series_id AS category_value, round_even(greatest(m - 2 * sd - 10, -0.01), 2) AS lower, round_even(least(m + 2 * sd + 10, 100.01), 2) AS upper, round(cov, 6) AS coverage_pct FROM t JOIN cv USING (series_id)"""


def _frequencies(spark, sf_dir, mode, **bounds):
    e = B.events(spark, sf_dir)
    top = [r["category_value"] for r in H.domain(e, "event_type").limit(5).collect()]
    p = PR.frequencies(H.distribution(e, "event_type"), "event_type", top, Guard(10, 2.0, 0.10), mode=mode, **bounds)
    return rounded(p.select("rule_type", "category_value", "lower", "upper", "coverage_pct"))


@query(_frequency_sql("CATEGORY_FREQUENCY_DYNAMIC", A._guard_points()))
def propose_frequency_dynamic(spark, sf_dir):
    return _frequencies(spark, sf_dir, "dynamic")


@query(_frequency_sql("CATEGORY_FREQUENCY_HYBRID", A._guard_points("AND value BETWEEN 18.5 AND 24.0")))
def propose_frequency_hybrid(spark, sf_dir):
    return _frequencies(spark, sf_dir, "hybrid", floor=18.5, ceiling=24.0)


@query("SELECT 'IS_PRIMARY_KEY' AS rule_type, 'l_orderkey' AS keys, true AS has_duplicates FROM lineitem HAVING count(*) > count(DISTINCT l_orderkey)")
def propose_duplicate_key(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("period", F.trunc(F.to_date("l_shipdate"), "MM"))  # noqa: E741
    return PR.primary_key(H.uniqueness(l, ["l_orderkey"]), ["l_orderkey"]).select("rule_type", F.array_join("values", ",").alias("keys"), "has_duplicates")


@query("""WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS c FROM orders) SELECT 'UNIQUENESS_CUSTOM_SQL' AS rule_type, 'o_orderkey,c' AS keys, NULL::DOUBLE AS lower FROM k HAVING count(*) > 0
UNION ALL SELECT 'COMPLETENESS', '', round_even(count(c) / count(*), 2) FROM k""")
def propose_key_with_nulls(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.trunc(F.to_date("o_orderdate"), "MM").alias("period"), "o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("c"))
    h = H.uniqueness(o, ["o_orderkey", "c"]).withColumn("duplicate_count", F.lit(0).cast("long"))  # rows without a whole key aren't duplicates here
    return PR.primary_key(h, ["o_orderkey", "c"]).select("rule_type", F.array_join("values", ",").alias("keys"), "lower")


@query(f"{_MONTHS}, h AS (SELECT period, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY period), raw AS (SELECT 'mean' AS series_id, period, mean AS value FROM h UNION ALL SELECT 'stddev', period, sd FROM h), {_SERIES}, {A.CHANGE}, "
       "po AS (SELECT v.series_id, value, row_number() OVER (PARTITION BY v.series_id ORDER BY v.idx DESC) AS r FROM valid v LEFT JOIN (SELECT * FROM cp WHERE n_post >= 5) c ON c.series_id = v.series_id WHERE c.change_idx IS NULL OR v.idx >= c.change_idx), "
       f"{_GUARDED.replace('FROM valid WHERE rn <= 12', 'FROM po WHERE r <= 12')} SELECT series_id AS metric_name, {_BOUNDS}")
def propose_subpopulation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("period", F.trunc(F.to_date("o_orderdate"), "MM"))
    p = PR.subpopulation(o, "o_totalprice", "o_orderpriority = '1-URGENT'", tuning.GUARD)
    return _bounds(p.where(F.col("rule_type").isin(ir.MEAN, ir.STDDEV)), "metric_name")


@query(f"{tuning.CALIBRATE}, c AS (SELECT *, CASE WHEN coverage_pct >= 90 AND fp = 0 THEN 'HIGH' WHEN coverage_pct >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM cal) SELECT series_id AS column_name, rule_type, CAST(n AS INTEGER) AS n, CAST(sigma AS DOUBLE) AS k FROM c, (VALUES ('MEAN_DUAL_GUARD'), ('STDDEV_DUAL_GUARD')) v(rule_type) WHERE confidence = 'HIGH' AND n_valid >= 5 AND NOT (series_id = 'events:click' AND rule_type = 'MEAN_DUAL_GUARD')")
def batch_calibrated(spark, sf_dir):
    """Each series' mean and deviation rule under its own calibrated parameters; the mean of clicks is known already."""
    s = B.all_series(spark, sf_dir)
    h = s.select(F.col("series_id").alias("column_name"), "period", F.col("value").alias("mean"), (F.abs("value") / 10).alias("stddev"), F.lit(1).alias("non_null_count"), F.lit(1).alias("total_count"))
    h = h.withColumn("column_name", F.translate("column_name", ":", "/"))
    cal = T.calibrate(s, R.series_profile(s)).withColumn("series_id", F.translate("series_id", ":", "/"))
    known = spark.createDataFrame([(ir.MEAN, "events/click")], "rule_type string, column_name string")
    return PR.calibrated(h, cal, known).select(F.translate("column_name", "/", ":").alias("column_name"), "rule_type", "n", "k")


@query(f"{_MONTHS.replace('o AS', 'o AS', 1)}, raw AS (SELECT 'rows' AS series_id, period, count(*) AS value FROM o GROUP BY period), {_SERIES}, {_GUARDED.replace('rn <= 12', 'rn <= 20').replace('12 PRECEDING', '20 PRECEDING')} SELECT 'ROW_COUNT_DUAL_GUARD' AS rule_type, 20 AS n, {_BOUNDS}")
def recalculate_row_count(spark, sf_dir):
    h = H.row_count(table(spark, sf_dir, "orders").withColumn("period", F.trunc(F.to_date("o_orderdate"), "MM")))
    old = ST.table_rules(h, tuning.GUARD)
    p = PR.recalculated(tuning._histories(spark, sf_dir), old, Guard(20, 2.0, 0.10), rows=h)
    return _bounds(p, "rule_type", "n")


@query(f"""{A.PROFILE} SELECT series_id, array_to_string(list_filter([CASE WHEN regime = 'STRUCTURAL_BREAK' THEN 'break' END, CASE WHEN regime = 'TRENDING' OR list_contains(h, 'TRENDING') THEN 'trend' END, CASE WHEN list_contains(h, 'SEASONAL') THEN 'weekly' END, CASE WHEN list_contains(h, 'VOLATILE') THEN 'volatile' END,
CASE WHEN list_contains(h, 'ASYMMETRIC') THEN 'skewed' END, CASE WHEN list_contains(h, 'ZERO_INFLATED') THEN 'zeros' END, CASE WHEN list_contains(h, 'SPARSE') THEN 'sparse' END], lambda x: x IS NOT NULL), ',') AS warnings FROM prof""")
def regime_warnings(spark, sf_dir):
    """Which warnings a series has, by a word of each."""
    w = R.warnings(R.series_profile(B.all_series(spark, sf_dir)))
    word = lambda x: F.when(x.startswith("the level"), "break").when(x.startswith("a trend"), "trend").when(x.startswith("a weekly"), "weekly").when(x.startswith("values vary"), "volatile").when(x.startswith("skewness"), "skewed").when(x.contains("zeros distort"), "zeros").otherwise("sparse")
    return w.select("series_id", F.array_join(F.transform("warnings", word), ",").alias("warnings"))
