"""Discovery: existence, columns, partition keys and values, ranges, volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.guards import identifier


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def healthy(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1 AS health").first()["health"] == 1


def columns(spark: SparkSession, table: str | None = None, df: DataFrame | None = None) -> list[dict]:
    """name, type, is_partition, position; names that are blank are left out, a missing type is string."""
    if table is not None:
        found = [(c.name, c.dataType, c.isPartition) for c in spark.catalog.listColumns(table)]
    else:
        found = [(f.name, f.dataType.simpleString(), False) for f in df.schema.fields]
    return [{"name": n, "type": t or "string", "is_partition": p, "position": i} for i, (n, t, p) in enumerate(found) if n and n.strip()]


def column_table(df: DataFrame) -> DataFrame:
    """The same as rows, from the schema alone."""
    spark = df.sparkSession
    rows = [(c["position"], c["name"], c["type"]) for c in columns(spark, df=df)]
    return spark.createDataFrame(rows, "position int, column_name string, physical_type string")


def partition_values(spark: SparkSession, table: str, column: str) -> DataFrame:
    """Values of a partition column from the catalog's list of partitions; no file is read."""
    part = F.explode(F.split("partition", "/"))
    pairs = spark.sql(f"SHOW PARTITIONS {table}").select(part.alias("p"))
    return pairs.where(F.substring_index("p", "=", 1) == identifier(column)).select(F.substring_index("p", "=", -1).alias("value")).distinct().orderBy("value")


def scanned_values(df: DataFrame, column: str) -> DataFrame:
    """The same by a scan that reads this column only."""
    return df.select(F.col(identifier(column)).alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def sample_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return df.select(F.col(identifier(column)).alias("value")).where(F.col("value").isNotNull()).distinct().limit(n)


def partition_range(spark: SparkSession, table: str, column: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """min_period, max_period, n_periods by metadata; values that don't parse are skipped."""
    day = dates.as_day(F.col("value"), fmt)
    return partition_values(spark, table, column).select(day.alias("d")).where(F.col("d").isNotNull()).agg(F.min("d").alias("min_period"), F.max("d").alias("max_period"), F.count_distinct("d").alias("n_periods"))


def volume(df: DataFrame) -> int:
    """Rows. A table that can't be counted is an error, since samples and timeouts rest on the number."""
    return df.count()


def freshness(max_day, today) -> str:
    """ok, warning beyond a week, stale beyond thirty days."""
    age = (today - max_day).days
    return "stale" if age > 30 else "warning" if age > 7 else "ok"
