"""What both vector searches share: which vectors take part, their layout in Arrow, samples, and final ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import seeded


def usable(df: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, v): rows whose vector is neither null nor holds a null, NaN or infinite component[, nor is zero]."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keep = v.isNotNull() & F.coalesce(finite, F.lit(False))
    if nonzero:
        keep &= F.exists(v, lambda x: x != 0)
    return df.where(keep).select(F.col("vec_id").cast("long"), v.alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and (lengths == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def sample(rows: DataFrame, n: int, dim: int, seed: int = 29) -> np.ndarray:
    """At most n distinct vectors, chosen by hash; documented bound of what the driver holds."""
    found = seeded(rows, F.col("v"), n, rows.count(), seed).select("_hash", "v").distinct().orderBy("_hash", "v").limit(n).select("v").toArrow()
    return matrix(found.column(0).combine_chunks(), dim) if len(found) else np.zeros((0, dim))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query's partial lists (q, query_id, vec_id, score)."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
