"""Exact top-k by integer inner product: pivot-table elimination.

Distances of every vector to some dozens of pivots are computed once and kept in a table beside the vectors. For a
query, the triangle inequality over all pivots gives a least distance to each vector, and so a greatest inner
product: q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2. Vectors are evaluated in the order of these bounds until the next bound
is below the k-th score found. Queries go out in groups of bounded size, one job each; a task reads its vectors
once for a group and compares them in blocks of queries. Vectors stay where they are, and only lists of k are shuffled.

Defined results: vectors of other lengths end in zeros; components count as floor(1024 * x); rows of the same id as the
query's are its own and no candidates; queries that repeat are answered each; null ids are no queries and come last
among ties; other columns, whatever their names, are ignored; an empty table gives no rows. Scores beyond 64 bits are cut to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Workspace, through
from .vectors import lists, matrix, ranked, sample, usable

SCALE, PIVOTS, SAMPLE_ROWS, QUERY_BLOCK, CHUNK = 1024, 48, 2048, 2048, 256
#: Bytes of query vectors that one job carries to all tasks.
JOB_BYTES = 16 << 20
FOUND = "q long, query_id long, vec_id long, score long"


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first among a sample."""
    if not len(x):
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


class Best:
    """The k best candidates of each query of a block, so far."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, pivots: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.norm, self.table = (q * q).sum(1), distances(q, pivots)
        self.score = [np.zeros(0) for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]
        self.evaluated = 0

    def bounds(self, norm: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Greatest inner product of each query with each vector, with room for rounding."""
        least = np.zeros((len(self.q), len(table)))
        for p in range(table.shape[1]):
            np.maximum(least, np.abs(self.table[:, p, None] - table[None, :, p]), out=least)
        both = self.norm[:, None] + norm[None]
        return (both - least * least) / 2 + 1 + both * 1e-9

    def add(self, x: np.ndarray, ids: np.ndarray, table: np.ndarray) -> None:
        """`ids` orders ties: null ids are the largest."""
        bound = self.bounds((x * x).sum(1), table)
        exact = (np.abs(self.q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1])) < 2**53
        for i, own in enumerate(self.ids):
            score, found = self.score[i], self.found[i]
            left = np.flatnonzero(ids != own)
            while len(left):
                if len(score) == self.k:
                    left = left[bound[i, left] >= score[-1]]
                if not len(left):
                    break
                top = np.argpartition(-bound[i, left], CHUNK)[:CHUNK] if len(left) > CHUNK else np.arange(len(left))
                now = left[top]
                got = x[now] @ self.q[i] if exact else np.array([float(sum(int(a) * int(b) for a, b in zip(r, self.q[i]))) for r in x[now]])
                score, found = np.concatenate([score, got]), np.concatenate([found, ids[now]])
                order = np.lexsort((found, -score))[: self.k]
                score, found = score[order], found[order]
                self.evaluated += len(now)
                left = np.delete(left, top)
            self.score[i], self.found[i] = score, found


def search(df: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, job_bytes: int = JOB_BYTES, work: Workspace | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for each row of df(vec_id, embedding) whose id `every` divides."""
    spark = df.sparkSession
    work = work or Workspace(spark, "pivots")
    rows = usable(df)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    pivot = choose_pivots(np.floor(SCALE * sample(rows, SAMPLE_ROWS, dim)), pivots)

    def prepared(batches):
        for batch in batches:
            x = np.floor(SCALE * matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x), lists(distances(x, pivot))], ["vec_id", "v", "table"])

    table = work.save(through(rows, prepared, "vec_id long, v array<double>, table array<double>"), "table")
    asked = table.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    n = asked.count()
    group = max(1, job_bytes // (8 * max(dim, 1) * query_block)) * query_block
    asked = work.save(asked.repartition(max(1, -(-n // group))).withColumn("q", F.monotonically_increasing_id()), "queries")
    block = F.struct(F.shiftright("q", 33).alias("part"), (F.col("q").bitwiseAND(F.lit((1 << 33) - 1)) / group).cast("long").alias("of"))
    out = None
    for b in asked.select(block.alias("b")).distinct().orderBy("b").collect():  # one row per group of queries
        part = asked.where((block["part"] == b["b"]["part"]) & (block["of"] == b["b"]["of"])).orderBy("q").toArrow()
        qv, qid, q = matrix(part.column("v").combine_chunks(), dim), part.column("vec_id").to_numpy(), part.column("q").to_numpy()

        def scan(batches, qv=qv, qid=qid, q=q):
            null, starts = np.iinfo(np.int64).max, range(0, len(q), query_block)
            blocks = [Best(qv[i : i + query_block], qid[i : i + query_block], pivot, k) for i in starts]
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    t = batch.slice(at, 4096)
                    ids, x, far = t.column(0).fill_null(null).to_numpy(), matrix(t.column(1), dim), matrix(t.column(2), len(pivot))
                    for best in blocks:
                        best.add(x, ids, far)
            for i, best in zip(starts, blocks):
                sizes = [len(s) for s in best.score]
                found = np.concatenate([*best.found, np.zeros(0, np.int64)])
                score = np.clip(np.concatenate([*best.score, np.zeros(0)]), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
                own, asker = np.repeat(q[i : i + query_block], sizes), np.repeat(best.ids, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(asker), pa.array(found, mask=found == null), pa.array(score)], ["q", "query_id", "vec_id", "score"])

        found = through(table, scan, FOUND)
        if n > group:
            found = work.save(found, f"found-{b['b']['part']}-{b['b']['of']}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], StructType.fromDDL(FOUND))
    return ranked(out, k)
