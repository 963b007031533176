"""Guards, predicates, specifications, sampling, presets, sessions, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dqspark.functions import dates, guards, sampling
from dqspark.operators import profile as P
from dqspark.sources import catalog, predicates
from dqspark.sources.session import CostLimit, Presets, QuerySession, cost, timeout_for
from dqspark.sources.spec import SourceSpec


@pytest.mark.parametrize("text", ["a; drop table x", "a -- b", "1 /* x */", "x in (select 1)", "union", "(a", "a))("])
def test_unsafe_filters(text):
    with pytest.raises(guards.UnsafeText):
        guards.filter_text(text)


def test_safe_filters():
    assert guards.filter_text(None) == "" and guards.filter_text(" a > 1 ") == "a > 1" and guards.filter_text("selected = 1")
    for name in ("1a", "a b", "", "a;b", None):
        with pytest.raises(guards.UnsafeText):
            guards.identifier(name)
    assert guards.equals_text("a", "O'K") == "a = 'O''K'"
    for bad in ("nan", "inf", "x"):
        with pytest.raises(guards.UnsafeText):
            guards.number(bad)


def test_formats():
    assert dates.detect_format(["20240101", "20240102"], False) == "yyyyMMdd" and dates.detect_format(["202401"], True) == "yyyyMM"
    assert dates.detect_format(["1700000000"], True) == "epoch_s" and dates.detect_format(["1700000000000"], True) == "epoch_ms" and dates.detect_format(["?"], False) == "yyyy-MM-dd"


def test_partitions_are_pruned(spark, tmp_path):
    df = spark.range(400).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("d")).select("id", F.year("d").alias("ano"), F.month("d").alias("mes"), F.dayofmonth("d").alias("dia"))
    df.write.partitionBy("ano", "mes", "dia").parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    p = predicates.partition_since(["ano", "mes", "dia"], dt.date(2024, 3, 15), {"ano": "yyyy", "mes": "MM", "dia": "dd"}, {"ano": True, "mes": True, "dia": True})
    found = t.where(p)
    assert found.count() == 400 - 74 * 4
    assert "PartitionFilters: [" in (plan := found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) and "PartitionFilters: []" not in plan


def test_catalog_of_a_partitioned_table(spark):
    spark.sql("DROP TABLE IF EXISTS parts")
    spark.range(6).select("id", F.concat(F.lit("2024-01-0"), (F.col("id") % 3 + 1).cast("string")).alias("dt")).write.partitionBy("dt").saveAsTable("parts")
    assert catalog.exists(spark, "parts") and not catalog.exists(spark, "nothing") and catalog.healthy(spark)
    assert [r["value"] for r in catalog.partition_values(spark, "parts", "dt").collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert catalog.partition_range(spark, "parts", "dt").first()["n_periods"] == 3
    assert [c["is_partition"] for c in catalog.columns(spark, "parts")] == [False, True]
    spec = SourceSpec("parts", method="incremental", partition_columns=("dt",), partition_formats={"dt": "yyyy-MM-dd"}, reference_day="2024-01-03", lookback=1)
    assert spec.resolve(spark).count() == 4
    assert spec.fingerprint() != SourceSpec("parts", lookback=2).fingerprint()
    assert SourceSpec("parts", method="incremental", partition_columns=("dt",), lookback=2, lookback_unit="periods").resolve(spark).select("period").distinct().count() == 2
    spark.sql("DROP TABLE parts")


def test_samples():
    assert sampling.sample_pct(1000) is None and sampling.sample_size(100) == 80
    assert sampling.sample_pct(10**12) == round(100 * 500_000 / 10**12, 4)
    for bad in ((0,), (10, 0.5), (10, 0.95, 0.9)):
        with pytest.raises(ValueError):
            sampling.sample_size(*bad)


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(None, "1", True, [1], dt.date(2024, 1, 1)), (None, "x", False, [2], None)], "nothing string, mixed string, flag boolean, list array<int>, day date")
    found = {r["column_name"]: r for r in P.classified(P.column_stats(df, exact=True), {"mixed": "FREE_TEXT"}).collect()}
    assert found["nothing"]["semantic_type"] == "UNKNOWN" and found["flag"]["semantic_type"] == "UNKNOWN" and found["list"]["semantic_type"] == "UNKNOWN" and found["day"]["semantic_type"] == "DATETIME"
    assert found["mixed"]["semantic_type"] == "FREE_TEXT" and found["mixed"]["castable_count"] == 1 and "mostly null" in found["nothing"]["warnings"]
    assert P.classified(P.column_stats(df.limit(0))).where("total_count = 0").count() == 5


def test_presets(tmp_path):
    p = Presets(str(tmp_path))
    p.save("a", {"x": 1, "y": 2})
    p.clone("a", "b")
    p.save("c", {"x": 1, "y": 3})
    p.mark_used("a")
    assert p.names() == ["a", "b", "c"] and p.compare("a", "c") == {"y": (2, 3)} and p.load("a")["uses"] == 1
    p.delete("b")
    for bad in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            p.load(bad)


def test_session(spark):
    s = QuerySession(spark, stop_usd=1e-9)
    assert s.collect(spark.range(3), "q")[0]["id"] == 0
    with pytest.raises(CostLimit):
        s.collect(spark.range(3), "q")
    s.reset()
    with pytest.raises(RuntimeError):
        s.collect(spark.range(3).select(F.raise_error(F.lit("no"))), "q")
    assert s.log().first()["status"] == "error" and cost(0) == 5e-5 and timeout_for(10**9) == 600


def test_stream_of_runs(spark, tmp_path):
    from dqspark.streaming.metrics import monitor, windowed_history

    rules = {"rows": "RowCount >= avg(last(5)) - 100", "full": "Completeness x >= 0.5"}
    for i in range(3):
        spark.createDataFrame([(float(j), f"2024-01-0{i + 1} 00:00:00") for j in range(4)], "x double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    monitor(stream, rules, str(tmp_path / "history"), str(tmp_path / "results"), str(tmp_path / "checkpoint")).awaitTermination()
    out = {(r["run"], r["rule_id"]): r["outcome"] for r in spark.read.parquet(str(tmp_path / "results")).collect()}
    assert out[0, "rows"] == "Failed" and out[1, "rows"] == "Passed" and out[2, "full"] == "Passed" and len(out) == 6
    q = windowed_history(stream, "ts", "x").writeStream.format("memory").queryName("hist").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hist").count() == 3
