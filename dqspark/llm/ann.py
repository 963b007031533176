"""Approximate nearest neighbours by inner product: learned partitions.

On a bounded sample of distinct vectors a graph of nearest neighbours is cut into partitions of equal size with few edges between
them; a small network learns from it which partitions hold a vector's neighbours. Every vector is put into
its most probable partition; a query visits as many of its most probable ones as reach the target recall on
the sample, and what they hold is ranked by exact inner products. Partitions are searched in blocks, queries against vectors, so
none is held by one task as a whole, and nothing is left out.

A score is the sum of the components' products from first to last, in double precision, so equal vectors score alike wherever they lie;
the matrix product only chooses, with a margin, whose scores are summed so.

Defined results: vectors of other lengths end in zeros; rows of the same id as the query's are its own and no
candidates; queries that repeat are answered each; null ids are no queries and come last among ties; other columns, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, through
from .nets import Adam
from .neardup import _bounds, _grouped
from .vectors import lists, matrix, ranked, sample, usable

#: Vectors that the index is fitted on at most, neighbours in its graph, and vectors per partition at least.
SAMPLE_ROWS, NEIGHBOURS, MIN_PART, MAX_PARTS, HIDDEN = 6000, 10, 128, 64, 64
TARGET = 0.96
#: Vectors, and queries, of a partition that are searched in one task.
BLOCK, QUERY_BLOCK = 8192, 1024


def nearest(x: np.ndarray, k: int, among: np.ndarray | None = None) -> np.ndarray:
    """Places of the k largest inner products of each row, its own excluded."""
    rows = np.arange(len(x)) if among is None else among
    k = min(k, len(x) - 1)
    out = np.zeros((len(rows), max(k, 0)), np.int64)
    for i in range(0, len(rows), 1024):
        s = x[rows[i : i + 1024]] @ x.T
        s[np.arange(len(s)), rows[i : i + 1024]] = -np.inf
        if k > 0:
            out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced(x: np.ndarray, graph: np.ndarray, parts: int, rng, rounds: int = 12) -> np.ndarray:
    """Partition of the graph's vertices: halves along principal directions, then moves to where most neighbours are, within a size limit."""
    label = np.zeros(len(x), np.int64)
    count = 1
    while count < parts:
        for p in range(count):
            own = np.flatnonzero(label == p)
            centred = x[own] - x[own].mean(0)
            v = rng.normal(size=x.shape[1])
            for _ in range(10):
                v = centred.T @ (centred @ v)
                v /= np.linalg.norm(v) + 1e-30
            label[own[np.argsort(centred @ v, kind="stable")[len(own) // 2 :]]] += count
        count *= 2
    limit = int(np.ceil(1.1 * len(x) / count))
    size = np.bincount(label, minlength=count)
    for _ in range(rounds):
        votes = np.zeros((len(x), count))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        gain = votes.max(1) - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            to = int(votes[i].argmax())
            if to != label[i] and size[to] < limit and rng.random() < 0.7:
                size[label[i]] -= 1
                size[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, summed from the first component to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Router:
    """A network with one hidden layer: probabilities of the partitions."""

    def __init__(self, p: dict[str, np.ndarray], probes: int):
        self.p, self.probes = p, probes

    def hidden(self, x):
        return np.maximum(x @ self.p["w1"] + self.p["b1"], 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        z = self.hidden(x) @ self.p["w2"] + x @ self.p["skip"] + self.p["b2"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(x: np.ndarray, k: int, target: float = TARGET, seed: int = 31, epochs: int = 30) -> Router:
    """Graph, partitions, network, and the number of partitions a query visits.

    That number is found with a sixth of the vectors as queries, which neither graph nor network has seen: so many partitions hold the
    target's share of their true neighbours.
    """
    rng = np.random.default_rng(seed)
    every, unseen = x, rng.permutation(len(x))[: min(1000, len(x) // 6)]
    x = np.delete(x, unseen, 0)
    parts = 1
    while parts * 2 * MIN_PART <= len(x) and parts < MAX_PARTS:
        parts *= 2
    dim = x.shape[1]
    p = {"w1": rng.normal(0, 1 / np.sqrt(max(dim, 1)), (dim, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.1, (HIDDEN, parts)), "skip": rng.normal(0, 0.1, (dim, parts)), "b2": np.zeros(parts)}
    router = Router(p, 1)
    if parts == 1:
        return router
    graph = nearest(x, NEIGHBOURS)
    label = balanced(x, graph, parts, rng)
    goal = np.zeros((len(x), parts))
    goal[np.arange(len(x)), label] += NEIGHBOURS / 2
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1)
    goal /= goal.sum(1, keepdims=True)
    unit, adam = x / np.linalg.norm(x, axis=1, keepdims=True), Adam(p, 0.01)
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = router.hidden(unit[at])
            err = (router.probabilities(unit[at]) - goal[at]) / len(at)
            dh = np.where(h > 0, err @ p["w2"].T, 0)
            adam.step({"w1": unit[at].T @ dh, "b1": dh.sum(0), "w2": h.T @ err, "skip": unit[at].T @ err, "b2": err.sum(0)}, 0.01 / (1 + 0.1 * epoch))
    true = nearest(every, k, unseen)
    home = router.probabilities(every).argmax(1)
    order = np.argsort(-router.probabilities(every[unseen]), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = place[np.arange(len(unseen))[:, None], home[true]]
    router.probes = int(next((m for m in range(1, parts + 1) if (needed < m).mean() >= target), parts))
    return router


def search(df: DataFrame, k: int = 20, every: int = 20, sample_rows: int = SAMPLE_ROWS, target: float = TARGET, block: int = BLOCK, query_block: int = QUERY_BLOCK, work: Workspace | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for each row of df(vec_id, embedding) whose id `every` divides."""
    spark = df.sparkSession
    work = work or Workspace(spark, "ann")
    rows = usable(df, nonzero=True)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    router = fit(sample(rows, sample_rows, dim), k, target)
    null = np.iinfo(np.int64).max

    def routed(batches):
        for batch in batches:
            x = matrix(batch.column(1), dim)
            order = np.argsort(-router.probabilities(x), axis=1, kind="stable")[:, : router.probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x), lists(order)], ["vec_id", "v", "parts"])

    index = work.save(through(rows, routed, "vec_id long, v array<double>, parts array<int>").withColumn("q", F.monotonically_increasing_id()), "index")
    is_query = F.col("vec_id") % every == 0
    visits = index.where(is_query).select("q", "vec_id", "v", F.explode("parts").alias("part"))
    homes = index.select("q", "vec_id", "v", F.col("parts")[0].alias("part"))
    sizes = homes.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row per partition, MAX_PARTS at most
    asked = visits.groupBy("part").agg(F.count("*").alias("n")).collect()

    def blocks(counts, size):
        pairs = [F.lit(x) for r in counts for x in (r["part"], max(1, -(-r["n"] // size)))]
        return F.coalesce(F.create_map(*pairs)[F.col("part")], F.lit(1)) if pairs else F.lit(1)

    c_blocks, q_blocks, h = blocks(sizes, block), blocks(asked, query_block), F.xxhash64("q")
    left = visits.withColumn("qb", F.pmod(h, q_blocks).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), c_blocks - 1))).withColumn("role", F.lit(0))
    right = homes.withColumn("cb", F.pmod(h, c_blocks).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), q_blocks - 1))).withColumn("role", F.lit(1))
    names = ["part", "qb", "cb", "role", "q", "vec_id", "v"]
    shuffle = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    both = left.select(*names).unionByName(right.select(*names)).repartition(shuffle, "part", "qb", "cb").sortWithinPartitions("part", "qb", "cb", "role")

    def rank(batches):
        for t in _grouped(batches, 3):
            part, qb, cb, role, q = (t.column(i).to_numpy() for i in range(5))
            ids, x = t.column(5).chunk(0).fill_null(null).to_numpy(), matrix(t.column(6).chunk(0), dim)
            norm = np.sqrt((x * x).sum(1))
            cuts = _bounds(part, qb, cb)
            for s, e in zip(cuts[:-1], cuts[1:]):
                middle = s + int((role[s:e] == 0).sum())
                for i in range(s, middle, 256):
                    j = min(i + 256, middle)
                    if middle == e:
                        continue
                    rough = x[i:j] @ x[middle:e].T
                    rough[ids[i:j, None] == ids[None, middle:e]] = -np.inf
                    # what may be among the k best, or tie with the last of them, within what rounding can make of it
                    slack = 1e-13 * dim * norm[i:j, None] * norm[None, middle:e]
                    last = max(0, rough.shape[1] - k)
                    least = np.partition(rough - slack, last, axis=1)[:, last]
                    a, b = np.nonzero((rough + slack >= least[:, None]) & (rough > -np.inf))
                    score = in_order(x[i + a], x[middle + b])
                    order = np.lexsort((ids[middle + b], -score, a))
                    a, b, score = a[order], b[order], score[order]
                    own = np.arange(len(a)) - np.searchsorted(a, a) < k
                    a, b, score = a[own], b[own], score[own]
                    found = ids[middle + b]
                    yield pa.RecordBatch.from_arrays([pa.array(q[i + a]), pa.array(ids[i + a]), pa.array(found, mask=found == null), pa.array(score)], ["q", "query_id", "vec_id", "score"])

    return ranked(through(both, rank, "q long, query_id long, vec_id long, score double"), k)
