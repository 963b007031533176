"""Histories: one aggregate per period, in one shuffle, on rows that carry a `period`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The quantiles of a numeric history.
QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def quantile_names() -> list[str]:
    return [f"p{round(q * 100):02d}" for q in QUANTILES]


def _keys(segment: str | None) -> list[str]:
    return ["period", *([segment] if segment else [])]


def numeric(df: DataFrame, column: str | Column, segment: str | None = None, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Counts, mean, sample deviation, range and nine quantiles by period[, segment]. Segments share one scan.

    Quantiles are those of a sketch of bounded size, merged from partial ones. Exact ones keep a map of a group's values, so ask for them only
    where a task holds a period's.
    """
    v = (F.col(column) if isinstance(column, str) else column).cast("double")
    rows = df.select(*_keys(segment), F.nanvl(v, F.lit(None).cast("double")).alias("v"))
    qs = F.array(*map(F.lit, QUANTILES))
    pct = F.percentile("v", qs) if exact else F.percentile_approx("v", list(QUANTILES), accuracy).cast("array<double>")
    found = rows.groupBy(*_keys(segment)).agg(
        F.count("*").alias("total_count"), F.count("v").alias("non_null_count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("stddev"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), pct.alias("pct")
    )
    return found.select(*_keys(segment), "total_count", "non_null_count", (F.col("total_count") - F.col("non_null_count")).alias("null_count"), "mean", "stddev", "min_value", "max_value", *[F.col("pct")[i].alias(n) for i, n in enumerate(quantile_names())])


def row_count(df: DataFrame, segment: str | None = None) -> DataFrame:
    return df.groupBy(*_keys(segment)).agg(F.count("*").alias("row_count"))


def volume(df: DataFrame, n: int = 50) -> DataFrame:
    """The newest n periods."""
    return row_count(df).orderBy(F.col("period").desc()).limit(n)


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("period").alias("min_period"), F.max("period").alias("max_period"), F.count_distinct("period").alias("n_periods"))


def distinct_counts(df: DataFrame, column: str, exact: bool = False, rsd: float = 0.023) -> DataFrame:
    """Distinct values, rows and non-null rows by period. Sketches have the standard error of Athena's APPROX_DISTINCT, so ten per cent are four of them or more."""
    v = F.col(column).cast("string")
    n = F.count_distinct(v) if exact else F.approx_count_distinct(v, rsd)
    return df.groupBy("period").agg(n.alias("distinct_count"), F.count("*").alias("total_count"), F.count(v).alias("non_null_count"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value by period. A null value stays null."""
    counts = df.groupBy("period", F.col(column).cast("string").alias("category_value")).agg(F.count("*").alias("value_count"))
    share = F.col("value_count") * 100.0 / F.sum("value_count").over(Window.partitionBy("period")).cast("double")
    return counts.withColumn("value_pct", share.cast("double"))


def domain(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Count and percentage of each value, most frequent first, ties by value."""
    counts = df.groupBy(F.col(column).cast("string").alias("category_value")).agg(F.count("*").alias("value_count"))
    total = counts.agg(F.sum("value_count").cast("double").alias("_total"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    out = out.select("category_value", "value_count", (F.col("value_count") * 100.0 / F.col("_total")).cast("double").alias("value_pct"))
    out = out.orderBy(F.col("value_count").desc(), F.col("category_value"))
    return out.limit(k) if k else out


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys, their difference, and non-null parts by period. A key with a null part counts as no key."""
    parts = [F.col(k).cast("string") for k in keys]
    whole = F.when(~_any_null(parts), F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))
    found = df.groupBy("period").agg(F.count("*").alias("total_rows"), F.count_distinct(whole).alias("distinct_keys"), *[F.count(F.col(k)).alias(f"non_null_{k}") for k in keys])
    return found.select("period", "total_rows", "distinct_keys", (F.col("total_rows") - F.col("distinct_keys")).alias("duplicate_count"), *[f"non_null_{k}" for k in keys])


def _any_null(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p.isNull()
    return out


def completeness(history: DataFrame) -> DataFrame:
    """period, value: non-null percentage, to two digits; periods without rows are left out."""
    pct = F.bround(F.col("non_null_count") / F.col("total_count") * 100, 2)
    return history.where("total_count > 0").select("period", pct.alias("value"))


def observed_values(df: DataFrame, column: str) -> DataFrame:
    """period, values: the set of non-null values."""
    return df.groupBy("period").agg(F.array_sort(F.collect_set(F.col(column).cast("string"))).alias("values"))


def densified(dist: DataFrame) -> DataFrame:
    """A distribution with 0 where a value is absent from a period that others have."""
    grid = dist.select("period").distinct().crossJoin(dist.select("category_value").distinct())  # periods by values of one column
    d, g = dist.alias("d"), grid.alias("g")
    on = (F.col("g.period") == F.col("d.period")) & F.col("g.category_value").eqNullSafe(F.col("d.category_value"))
    return g.join(d, on, "left").select("g.period", "g.category_value", F.coalesce("d.value_count", F.lit(0)).cast("long").alias("value_count"), F.coalesce("d.value_pct", F.lit(0.0)).alias("value_pct"))
