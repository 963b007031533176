"""Queries by name: a callable over (spark, sf_dir), and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name.split(".")[-1])


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """All doubles to six digits, or as many as named for a column, on both engines alike."""
    return df.select(*[F.round(F.col(n), digits.get(n, 6)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])
