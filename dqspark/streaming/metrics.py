"""A stream of rows judged in micro-batches: each batch is a run, its metrics join the history that later runs look back on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..rules.evaluate import evaluate, metric_rows

HISTORY = "metric string, run long, value double"


def _stored(spark, path: str, schema: str | None = None) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def judge(rules: dict[str, str], history_path: str, results_path: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls. A batch that runs again replaces its own metrics and results, so retries count once."""

    def batch(df: DataFrame, run: int) -> None:
        spark = df.sparkSession
        df = df.persist()  # metrics and results read it
        try:
            past = _stored(spark, history_path, HISTORY)
            past = past.where(F.col("run") < run) if past is not None else None
            evaluate(df, rules, past).withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{results_path}/batch={run}")
            metric_rows(df, rules, run).select("metric", F.col("run").cast("long"), "value").write.mode("overwrite").parquet(f"{history_path}/batch={run}")
        finally:
            df.unpersist()

    return batch


def monitor(stream: DataFrame, rules: dict[str, str], history_path: str, results_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts judging a stream; by default all that is there, then it stops."""
    writer = stream.writeStream.foreachBatch(judge(rules, history_path, results_path)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_history(stream: DataFrame, ts: str, column: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Row count, completeness and mean by event-time window, with late rows up to the watermark."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"))
    return rows.agg(F.count("*").alias("total_count"), F.count(column).alias("non_null_count"), F.avg(F.col(column).cast("double")).alias("mean")).select(F.col("w.start").alias("period"), "total_count", "non_null_count", "mean")
