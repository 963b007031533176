"""Sinks: partitioned Parquet, as a path or a catalog table, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.guards import identifier


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, or in the warehouse where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/dqspark-{identifier(name)}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> DataFrame:
    """df as Parquet with a folder per value of the columns, each written by the tasks that hold it; what was written, read again."""
    df.repartition(*columns).write.mode(mode).partitionBy(*map(identifier, columns)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_table(df: DataFrame, table: str, path: str, columns: list[str]) -> DataFrame:
    """The same as an external catalog table, whose partitions the catalog knows."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {identifier(table)}")
    df.repartition(*columns).write.partitionBy(*map(identifier, columns)).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
