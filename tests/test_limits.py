"""Scores at a level's limit or of odd series, and sketches of many periods within theirs."""

import shutil

import duckdb
import pytest

from dqspark import plans
from dqspark.operators import history as H
from dqspark.operators import proposals as PR
from dqspark.rules import ir

TESTED = "proposal_id string, rule_type string, total_periods long, coverage_pct double, stability_score double, false_positive_proxy long, band_width_ratio double, valid_count long, regime string, null_pct double, is_zero_inflated boolean"


@pytest.mark.parametrize("cover, stable, regime, null_pct, score, level", [(100.0, 0.6, "SPARSE", 33.33, 0.8, "HIGH"), (99.9, 0.6, "SPARSE", 33.33, 0.7997, "MEDIUM"), (5.0, 0.6, "STRUCTURAL_BREAK", 0.0, 0.5075, "LOW")])
def test_levels_go_by_the_score_shown(spark, cover, stable, regime, null_pct, score, level):
    row = ("a", ir.MEAN, 13, cover, stable, 0, 0.05, 20, regime, null_pct, False)
    got = PR.scored(spark.createDataFrame([row], TESTED)).first()
    assert (got["score_total"], got["confidence"]) == (score, level)


def test_distinct_sketches_of_many_days_are_near(spark, tmp_path):
    rows = spark.range(200 * 3000).selectExpr("id AS event_id", "id AS user_id", "'view' AS event_type", "1.0D AS value", "timestamp_seconds(1704067200 + 86400 * (id % 200)) AS ts")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = plans.queries()["distinct_sketch_error"](spark, str(tmp_path)).collect()
    assert len(got) == 200 and {r["total_count"] for r in got} == {3000} and all(r["near"] for r in got)


def test_distinct_counts_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, None)], "period int, u string")
    for exact in (False, True):
        got = sorted(tuple(r) for r in H.distinct_counts(df, "u", exact=exact).collect())
        assert got == [(1, 0, 2, 0), (2, 1, 3, 2)] and H.distinct_counts(df.limit(0), "u", exact=exact).count() == 0


def test_scores_of_tables_rewritten_in_place(spark, small, tmp_path):
    def scores(folder, kept):
        (tmp_path / folder).mkdir(exist_ok=True)
        shutil.copyfile(f"{small}/orders.parquet", tmp_path / folder / "orders.parquet")
        duckdb.sql(f"COPY (SELECT * FROM '{small}/events.parquet' WHERE {kept}) TO '{tmp_path / folder}/events.parquet' (FORMAT parquet)")
        return sorted(map(tuple, plans.queries()["score_proposals"](spark, str(tmp_path / folder)).collect()))

    scores("one", "event_id % 2 = 0")
    assert scores("one", "event_type <> 'error'") == scores("two", "event_type <> 'error'")


ODD = {"few": "CASE WHEN d IN (3, 9) THEN 100.0 + d END", "none": "NULL", "zeros": "CASE WHEN d IN (1, 2, 29) THEN 100.0 + d ELSE 0.0 END", "tie": "CASE WHEN d < 4 THEN 2.0 WHEN d = 4 THEN 4.0 END"}


def test_scores_of_odd_series_are_those_of_the_sql(spark, small, tmp_path):
    rows = " UNION ALL ".join(f"SELECT '{name}' AS event_type, d, CAST({value} AS DOUBLE) AS value FROM range(30) t(d)" for name, value in ODD.items())
    duckdb.sql(f"COPY (SELECT 17 * (row_number() OVER ()) + 1 AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AS ts, event_type, value FROM ({rows}) r) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    shutil.copyfile(f"{small}/orders.parquet", tmp_path / "orders.parquet")
    df = plans.queries()["score_proposals"](spark, str(tmp_path))
    c = duckdb.connect()
    for name in ("events", "orders"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = c.sql(plans.oracle_sql()["score_proposals"]).select(*df.columns).fetchall()
    assert len(want) >= len(ODD) and sorted(map(tuple, df.collect())) == sorted(want)


def test_scores_that_end_in_a_half_are_rounded_as_in_the_sql(spark):
    fits = {"STABLE": "1.0", "VOLATILE": "0.6", "TRENDING": "0.5", "SEASONAL": "0.7", "STRUCTURAL_BREAK": "0.3"}
    cases = [(k * 6.25, stable, regime) for k in range(1, 16, 2) for stable in ("0.2", "0.4", "0.6", "0.8", "1.0") for regime in fits]
    rows = [(str(i), ir.MEAN, 16, cover, float(stable), 0, 0.5, 20, regime, 0.0, False) for i, (cover, stable, regime) in enumerate(cases)]
    got = {int(r["proposal_id"]): r["score_total"] for r in PR.scored(spark.createDataFrame(rows, TESTED)).collect()}
    for i, (cover, stable, regime) in enumerate(cases):
        want = duckdb.sql(f"SELECT round(greatest(0.0, least(1.0, 0.30 * CAST({cover} AS DOUBLE) / 100 + 0.20 * {stable} + 0.10 + 0.10 + 0.15 * {fits[regime]} + 0.15 * 0.95 - 0.10 * 0.00)), 4)").fetchall()[0][0]
        assert got[i] == want, cases[i]
