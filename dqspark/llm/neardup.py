"""Near-duplicate documents by a chosen-path similarity join on word shingles.

A document is the set of its distinct shingles of five lower-cased words. Sets that are equal are one vertex.
Each vertex has a sketch of 128 minwise values. In each of several independent trees a vertex starts at the
root, and at every node takes the two sketch positions that the node's path chooses; the values there lead to two
children. Nodes of depth 3 branch on, two levels at a time, until they are small or do not get smaller; vertices that meet in one then are
candidates. A pair at the threshold meets in a tree, however deep it is, with the probability that a branching process never dies
out, and there are as many trees as the target recall asks for.
Nodes are compared exhaustively, in blocks, but for pairs that links already connect: in the first rounds each member
takes its most similar sketch among a node's most central members and a few others. Vertices that are then similar to one of another
component get a second, wide sketch, or carry their set if that is small, which settles pairs below the threshold. Each takes its best by this
sketch, and what these links too leave apart is compared in full; a pair that meets in several nodes is taken in the first
of them. A candidate is a link only if the full sets confirm it.

Defined results: a document of fewer than five words is one shingle, its whole sequence; a document without words, or
with a null text, has no shingles and is linked with nothing; a long text counts whole; rows that repeat are in one component;
of a component's documents the smallest id names it, so there are no ties; a null id is linked
with nothing and has a null component; an empty table gives no rows; other columns, whatever their names, are ignored by
:func:`dedup` and kept by :func:`distinct_documents`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import LOWER, Workspace, buffers, fresh, hashed_words, mix64, slices, text_column, through
from .components import components

WORDS, SKETCH, DEPTH, BRANCH = 5, 128, 3, 2
THRESHOLD, RECALL = 0.8, 0.999999
#: Rows of a node that meet its figures together, before they go to blocks.
PART = 512
#: Members of a node that are compared in one task, of these the sample that first rounds look at, the size at which nodes branch on, and how often they do.
BLOCK, SAMPLE, BRANCH_ON, BRANCHINGS = 2048, 64, 1 << 15, 4
#: Rows of ids and 16-byte keys that are broadcast at most, some 30 MB; beyond that the texts are shuffled.
BROADCAST_IDS = 500_000
_STEP = 0x9E3779B97F4A7C15
#: Odd factors: of the words of a shingle, and of the minwise functions.
_PLACE = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)
_MINWISE = mix64(np.arange(101, 101 + SKETCH, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)
#: The wide sketch: one byte of each of so many other minwise values. Sets up to SMALL members go as they are, and are compared exactly.
WIDE, SMALL = 1024, 256
_WIDE = mix64(np.arange(10_001, 10_001 + WIDE, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their numbers."""
    words, counts = hashed_words(LOWER[data], offsets)
    n = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc = np.repeat(np.arange(len(counts)), n)
    size = np.minimum(counts, WORDS)[doc]
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    h = size.astype(np.uint64)
    for k in range(WORDS):
        h = h + np.where(size > k, padded[first + k] * _PLACE[k], np.uint64(0))
    h = mix64(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(counts))


def _sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes that name a set: two sums over mixed members."""
    return np.stack([np.add.reduceat(h, first), np.add.reduceat(mix64(h + np.uint64(_STEP)), first)], 1)


def signed(batches, what: str):
    """Per text: number of shingles, the set's key, and its sketch, its wide sketch or its members."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for i, j in slices(offsets):
            h, n = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            full = n > 0
            first = (np.cumsum(n) - n)[full]
            keys, extra = np.full(j - i, None, object), np.full(j - i, None, object)
            if len(h):
                keys[full] = [k.tobytes() for k in _sums(h, first)]
                if what == "members":
                    extra[full] = _objects(np.split(h.view(np.int64), first[1:]))
                else:
                    factors, kind = (_MINWISE, np.uint16) if what == "sketch" else (_WIDE, np.uint8)
                    values = np.empty((len(first), len(factors)), kind)
                    for k, f in enumerate(factors):
                        values[:, k] = mix64(np.minimum.reduceat(h * f, first)).astype(kind)  # the top bits of a minimum are mostly 0
                    extra[full] = [v.tobytes() if what == "sketch" or size > SMALL else m.tobytes() for v, m, size in zip(values, np.split(h, first[1:]), n[full])]
            kind = pa.list_(pa.int64()) if what == "members" else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(extra, kind)], ["doc_id", "n", "key", "extra"])


def _objects(parts: list) -> np.ndarray:
    out = np.empty(len(parts), object)
    for i, x in enumerate(parts):
        out[i] = x
    return out


def trees_for(threshold: float, recall: float) -> int:
    """Trees after which a pair at the threshold has met with the target probability.

    A node's two children are shared with the threshold's probability each, so a pair still shares a node at any depth with at least the
    probability s = 1 - (1 - threshold * s)^2 that such a process never ends; deeper trees lose nothing beyond that.
    """
    if threshold * BRANCH <= 1:
        raise ValueError("so low a threshold leaves pairs apart in deep trees")
    s = 1.0
    for _ in range(200):
        s = 1 - (1 - threshold * s) ** BRANCH
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def children(state: np.ndarray, sketch: np.ndarray, levels: int) -> np.ndarray:
    """Nodes `levels` below each row's node: (rows, BRANCH ** levels)."""
    state = state.reshape(-1, 1)
    for _ in range(levels):
        one = state % np.uint64(SKETCH)
        two = (one + np.uint64(1) + (state >> np.uint64(8)) % np.uint64(SKETCH - 1)) % np.uint64(SKETCH)
        out = []
        for place in (one, two):
            value = np.take_along_axis(sketch, place.astype(np.int64), 1).astype(np.uint64)
            out.append(mix64(state * np.uint64(_STEP | 1) + place * np.uint64(1 << 16) + value + np.uint64(1)))
        state = np.concatenate(out, 1)
    return state


def _sketches(column) -> np.ndarray:
    return buffers(column)[0].view(np.uint16).reshape(len(column), SKETCH)


def leaves_of(sketch: np.ndarray, trees: int) -> np.ndarray:
    """Nodes of depth DEPTH of all trees, one column each."""
    roots = [mix64(np.full(len(sketch), t + 1, np.uint64) * np.uint64(_STEP)) for t in range(trees)]
    return np.concatenate([children(r, sketch, DEPTH) for r in roots], 1)


def paths(reps: DataFrame, trees: int) -> DataFrame:
    """(node, rid, leaf): the nodes of depth DEPTH that each vertex reaches, and by which path."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                nodes = leaves_of(_sketches(part.column(1)), trees)
                rid, leaf = np.repeat(part.column(0).to_numpy(), nodes.shape[1]), np.tile(np.arange(nodes.shape[1], dtype=np.int32), len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(rid), pa.array(leaf)], ["node", "rid", "leaf"])

    return through(reps.select("rid", "sketch"), run, "node long, rid long, leaf int")


def deeper(members: DataFrame, levels: int = 2) -> DataFrame:
    """(node, rid, leaf): children of very large nodes; their leaf is -1."""

    def run(batches):
        for batch in batches:
            nodes = children(batch.column(0).to_numpy().view(np.uint64), _sketches(batch.column(2)), levels)
            rid = np.repeat(batch.column(1).to_numpy(), nodes.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(rid), pa.array(np.full(len(rid), -1, np.int32))], ["node", "rid", "leaf"])

    return through(members.select("node", "rid", "sketch"), run, "node long, rid long, leaf int")


def shared_nodes(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, rid, leaf, size) of nodes that hold two vertices at least; of nodes with the same vertices one is kept.

    Most nodes hold one vertex, so all are only counted, and what names a node's vertices is made for the others.
    """
    nodes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    rows = work.save(rows.join(nodes, "node").select("node", "rid", "leaf", "size"), name)
    nodes = rows.groupBy("node", "size").agg(F.bit_xor(F.xxhash64("rid")).alias("who"))
    return rows.join(nodes.groupBy("size", "who").agg(F.min("node").alias("node")).select("node"), "node", "left_semi")


def few(ids: DataFrame) -> DataFrame:
    """A list of ids, to be broadcast if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def branched(rows: DataFrame, info: DataFrame, work: Workspace, large: int) -> DataFrame:
    """(node, rid, leaf, size): nodes over `large` members give way to what they branch into; what stays large after BRANCHINGS is alike in most of its sketches."""
    out, big = rows.where(F.col("size") <= large), rows.where(F.col("size") > large)
    for turn in range(BRANCHINGS):
        if big.isEmpty():
            return out
        below = work.save(shared_nodes(deeper(big.join(info.select("rid", "sketch"), "rid")), work, f"shared-{turn}").select(*rows.columns), f"branched-{turn}")
        work.drop(f"shared-{turn}")
        out, big = out.unionByName(below.where(F.col("size") <= large)), below.where(F.col("size") > large)
    return out.unionByName(big)


def _grouped(batches, n_keys: int):
    """Tables of whole groups from batches that are sorted by their first columns."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if len(held) < 4096:
            continue
        keys = np.stack([held.column(k).to_numpy() for k in range(n_keys)], 1)
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
        if len(change):
            cut = int(change[-1]) + 1
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut).combine_chunks()
    if held is not None and len(held):
        yield held


def _bounds(*keys: np.ndarray) -> np.ndarray:
    change = np.zeros(len(keys[0]) + 1, bool)
    change[0] = change[-1] = True
    for k in keys:
        change[1:-1] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal sketch positions of all pairs, in steps of bounded memory."""
    out = np.empty((len(a), len(b)), np.int16)
    step = max(1, (1 << 18) // max(1, len(b)))
    for i in range(0, len(a), step):
        out[i : i + step] = (a[i : i + step, None, :] == b[None]).sum(2)
    return out


def _sampled(sketch: np.ndarray, rid: np.ndarray, turn: int) -> np.ndarray:
    """Places of a node's sample: those that agree most with the commonest value of each position, and a seeded quarter."""
    if len(rid) <= SAMPLE:
        return np.arange(len(rid))
    seeded = np.argsort(mix64(rid.view(np.uint64) + np.uint64(turn * 7919)))
    some = np.sort(sketch[seeded[:257]], axis=0)
    middle = some[len(some) // 2]  # a value that most share is the median too
    central = np.argsort(-(sketch == middle).sum(1), kind="stable")
    return np.unique(np.concatenate([central[: SAMPLE - SAMPLE // 4], seeded[: SAMPLE // 4]]))


def candidates(members: DataFrame, least: int, threshold: float, turn: int, partitions: int) -> DataFrame:
    """(a, b): each member's most similar vertex of another component, among a sample of its node's block."""
    rows = members.withColumn("block", F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / BLOCK)))
    rows = rows.select("node", "block", "rid", "comp", "n", "sketch").repartition(partitions, "node", "block").sortWithinPartitions("node", "block")

    def run(batches):
        for t in _grouped(batches, 2):
            node, block, rid, comp, n = (t.column(k).to_numpy() for k in range(5))
            sketch = _sketches(t.column(5).chunk(0))
            cuts = _bounds(node, block)
            out_a, out_b = [], []
            sizes = np.diff(cuts)
            i = cuts[:-1][sizes == 2]
            ok = (comp[i] != comp[i + 1]) & (np.minimum(n[i], n[i + 1]) >= threshold * np.maximum(n[i], n[i + 1]) - 1e-9)
            i = i[ok]
            i = i[(sketch[i] == sketch[i + 1]).sum(1) >= least]
            out_a.append(rid[i])
            out_b.append(rid[i + 1])
            for s, e in zip(cuts[:-1][sizes > 2], cuts[1:][sizes > 2]):
                if comp[s:e].min() == comp[s:e].max():
                    continue
                order = _sampled(sketch[s:e], rid[s:e], turn) + s
                agree = _agreeing(sketch[s:e], sketch[order])
                fit = np.minimum(n[s:e, None], n[order][None]) >= threshold * np.maximum(n[s:e, None], n[order][None]) - 1e-9
                agree = np.where(fit & (comp[s:e, None] != comp[order][None]), agree, -1)
                best = agree.argmax(1)
                good = agree[np.arange(e - s), best] >= least
                out_a.append(rid[s:e][good])
                out_b.append(rid[order[best[good]]])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return through(rows, run, "a long, b long").distinct()


def _similar(rows: DataFrame, payload: DataFrame, partitions: int) -> DataFrame:
    """Rows of nodes dealt so that members outside the most frequent component meet all members, block by block on both sides.

    Rows meet the figures of their node by part of it, so no task takes a whole large node, and take their vertex's payload once they are dealt.
    """
    counts = rows.groupBy("node", "size", "comp").agg(F.count("*").alias("k"))
    most = counts.groupBy("node", "size").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"))
    most = most.select("node", "size", F.col("top.comp").alias("top"), F.ceil((F.col("all") - F.col("top.k")) / BLOCK).cast("int").alias("p_blocks"), F.ceil(F.col("all") / BLOCK).cast("int").alias("m_blocks")).where("p_blocks > 0")
    parts = F.ceil(F.col("size") / PART).cast("int")
    most = most.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("size")
    names = [c for c in rows.columns if c != "size"]
    h = F.xxhash64("rid")
    rows = rows.withColumn("part", F.pmod(h, parts).cast("int")).drop("size").join(most, ["node", "part"])
    probes = rows.where("comp != top").withColumn("p", F.pmod(h, F.col("p_blocks")).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1))).withColumn("role", F.lit(1))
    others = rows.withColumn("m", F.pmod(h, F.col("m_blocks")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1))).withColumn("role", F.lit(0))
    columns = ["node", "p", "m", "role", *[c for c in names if c != "node"]]
    dealt = probes.select(*columns).unionByName(others.select(*columns)).join(payload, "rid")
    return dealt.select(*columns, *[c for c in payload.columns if c != "rid"]).repartition(partitions, "node", "p", "m").sortWithinPartitions("node", "p", "m")


def _pairs(t, least: int, threshold: float):
    """(i, j): places of probes and members of one block whose components differ and whose sketches are similar."""
    node, p, m, role = (t.column(k).to_numpy() for k in range(4))
    rid, comp, n, sketch = t.column("rid").to_numpy(), t.column("comp").to_numpy(), t.column("n").to_numpy(), _sketches(t.column("sketch").chunk(0))
    cuts = _bounds(node, p, m)
    for s, e in zip(cuts[:-1], cuts[1:]):
        i, j = np.flatnonzero(role[s:e] == 1) + s, np.flatnonzero(role[s:e] == 0) + s
        for k in range(0, len(i) if len(j) else 0, 256):
            q = i[k : k + 256]
            good = (_agreeing(sketch[q], sketch[j]) >= least) & (comp[q][:, None] != comp[j][None])
            good &= np.minimum(n[q][:, None], n[j][None]) >= threshold * np.maximum(n[q][:, None], n[j][None]) - 1e-9
            x, y = np.nonzero(good)
            if len(x):
                yield q[x], j[y]


def involved(rows: DataFrame, info: DataFrame, least: int, threshold: float, partitions: int) -> DataFrame:
    """(rid): vertices that are similar to one of another component."""

    def run(batches):
        for t in _grouped(batches, 3):
            rid = t.column("rid").to_numpy()
            found = [rid[np.unique(np.concatenate(ij))] for ij in _pairs(t, least, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([*found, np.zeros(0, np.int64)])))], ["rid"])

    return through(_similar(rows.select("node", "rid", "size", "comp"), info.select("rid", "n", "sketch"), partitions), run, "rid long").distinct()


def wide_candidates(rows: DataFrame, wide: DataFrame, least: int, threshold: float, trees: int, partitions: int, best: bool) -> DataFrame:
    """(a, b): pairs of different components that are similar by both sketches, which wide(rid, n, sketch, wide) has.

    Either each probe's best in a block, or all; each from the first node that it meets in. Small sets are compared as they are.
    """
    rows = rows.join(wide.select("rid"), "rid")
    mask = rows.where("leaf >= 0").groupBy("rid").agg(F.bit_or(F.expr("shiftleft(1L, leaf)")).alias("mask"))
    rows = rows.join(mask, "rid", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    least_wide = threshold - 5 * math.sqrt(threshold * (1 - threshold) / WIDE)

    def run(batches):
        for t in _grouped(batches, 3):
            rid, leaf, mask = t.column("rid").to_numpy(), t.column("leaf").to_numpy(), t.column("mask").to_numpy()
            data, at = buffers(t.column("wide").chunk(0))
            large = t.column("n").to_numpy() > SMALL
            bytes_ = np.zeros((len(rid), WIDE), np.uint8)
            for x in np.flatnonzero(large):
                bytes_[x] = data[at[x] : at[x + 1]]
            members = [None if big else data[p:q].tobytes() for big, p, q in zip(large, at[:-1].tolist(), at[1:].tolist())]
            members = [None if m is None else np.frombuffer(m, np.uint64) for m in members]
            paths_, bits = leaves_of(_sketches(t.column("sketch").chunk(0)), trees), np.arange(trees * BRANCH**DEPTH)
            for i, j in _pairs(t, least, threshold):
                for k in range(0, len(i), 4096):
                    a, b = i[k : k + 4096], j[k : k + 4096]
                    shared = (paths_[a] == paths_[b]) & (((mask[a] & mask[b])[:, None] >> bits[None]) & 1).astype(bool)
                    first = (leaf[a] < 0) | (shared.argmax(1) == leaf[a])
                    a, b = a[first], b[first]
                    alike = ((bytes_[a] == bytes_[b]).sum(1) / WIDE - 1 / 256) / (1 - 1 / 256)
                    good = alike >= least_wide
                    for x in np.flatnonzero(~large[a] | ~large[b]):
                        u, v = members[a[x]], members[b[x]]
                        if u is None or v is None:
                            alike[x], good[x] = threshold, True  # one of either kind: left to the full sets
                            continue
                        both = len(np.intersect1d(u, v, assume_unique=True))
                        alike[x] = both / (len(u) + len(v) - both)
                        good[x] = alike[x] >= threshold - 1e-9
                    a, b, alike = a[good], b[good], alike[good]
                    if best:
                        order = np.lexsort((-alike, a))
                        a, b = a[order], b[order]
                        top = np.ones(len(a), bool)
                        top[1:] = a[1:] != a[:-1]
                        a, b = a[top], b[top]
                    a, b = rid[a], rid[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    names = ["node", "rid", "size", "comp", "leaf", "mask"]
    return through(_similar(rows.select(*names), wide, partitions), run, "a long, b long").distinct()


def from_texts(rows: DataFrame, ids: DataFrame, what: str) -> DataFrame:
    """(rid, extra) for ids(rid, key, first_id): full sets or wide sketches, from the texts that they were first seen in.

    A list of ids that is small enough is broadcast, and no text is shuffled; rows that repeat an id give a set more than once,
    which changes no link.
    """
    ids = few(ids)
    some = rows.join(ids.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi")
    found = through(some, lambda b: signed(b, what), "doc_id long, n long, key binary, extra " + ("array<long>" if what == "members" else "binary"))
    return found.join(ids.select("rid", "key"), "key").select("rid", "extra")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: float) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("rid").alias("a"), F.col("members").alias("sa"))
    right = sets.select(F.col("rid").alias("b"), F.col("members").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= F.lit(percent) * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def merged(comps: DataFrame | None, links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Components after further links: these are drawn between the components so far, so each pair of those counts once."""
    if comps is None:
        return components(links, work, name)
    for end in ("a", "b"):
        own = comps.select(F.col("v").alias(end), F.col("comp").alias("c"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    new = components(links.where("a != b").distinct(), work, name)
    moved = comps.join(new.select(F.col("v").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("v", F.coalesce("to", "comp").alias("comp"))
    return work.save(moved.unionByName(new), f"{name}-all")


def judged(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rounds: int = 1, work: Workspace | None = None, branch_on: int = BRANCH_ON) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the set's key for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "neardup")
    percent = round(100 * threshold, 6)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    rows = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    signs = work.save(through(rows, lambda b: signed(b, "sketch"), "doc_id long, n long, key binary, extra binary"), "signs")
    some = signs.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    reps = some.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("extra").alias("sketch"))
    reps = work.save(reps.withColumn("rid", F.monotonically_increasing_id()), "reps")
    trees = trees_for(threshold, recall)
    if trees * BRANCH**DEPTH > 62:
        raise ValueError("so low a threshold takes more trees than there are bits for paths")
    info, keyed_ids = reps.select("rid", "n", "sketch"), reps.select("rid", "key", "first_id")
    members = work.save(shared_nodes(paths(reps, trees), work, "shared").select("node", "rid", "leaf", "size"), "members")
    members = branched(members, info, work, branch_on)
    info = work.save(info.join(few(members.select("rid").distinct()), "rid", "left_semi"), "info")
    work.release()
    least = math.floor(SKETCH * threshold - 5 * math.sqrt(SKETCH * threshold * (1 - threshold)))
    found = members.select("node", "rid", "leaf", "size")
    comps = sets = None
    wide, last = None, rounds + 1
    for turn in range(last + 1):
        state = found if comps is None else found.join(comps, found["rid"] == comps["v"], "left").drop("v")
        state = state.withColumn("comp", F.col("rid") if comps is None else F.coalesce("comp", "rid"))
        if comps is not None:
            apart = state.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("node")
            state = work.save(state.join(apart, "node", "left_semi"), f"apart-{turn}")
            found = state.select("node", "rid", "leaf", "size")
        if turn < rounds:
            pairs = candidates(state.join(info, "rid"), least, threshold, turn, parts)
        else:
            if wide is None:
                some = work.save(involved(state, info, least, threshold, parts).join(keyed_ids, "rid"), "involved")
                wide = from_texts(rows, some, "wide").withColumnRenamed("extra", "wide").dropDuplicates(["rid"])
                wide = work.save(info.join(few(some.select("rid")), "rid", "left_semi").join(wide, "rid"), "wide")
                work.release()
            pairs = wide_candidates(state, wide, least, threshold, trees, parts, best=turn < last)
        pairs = work.save(pairs, f"pairs-{turn}")
        work.release()
        # only documents of candidate pairs get their full sets, once
        ids = ends = work.save(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct(), f"ends-{turn}")
        if sets is not None:
            ids = ids.join(sets.select("rid"), "rid", "left_anti")
        ids = work.save(ids.join(keyed_ids, "rid"), f"ids-{turn}")
        new = work.save(from_texts(rows, ids, "members").withColumnRenamed("extra", "members"), f"sets-{turn}")
        sets = new if sets is None else sets.unionByName(new)
        new = work.save(confirmed(pairs, sets.join(few(ends), "rid", "left_semi"), percent), f"links-{turn}")
        work.release()
        if comps is not None and new.isEmpty():
            continue
        comps = merged(comps, new, work, f"components-{turn}")
    stale = [f"{x}-{turn}" for turn in range(last + 1) for x in ("sets", "pairs", "ends", "ids", "links", "apart")]
    for name in ("shared", "info", "members", "wide", "involved", *(f"branched-{turn}" for turn in range(BRANCHINGS)), *stale):
        work.drop(name)
    named = reps.join(comps, reps["rid"] == comps["v"], "left").select("key", "first_id", F.coalesce("comp", "rid").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = work.save(named.join(lowest, "comp").select(F.col("key").alias("k"), "component_id"), "named")
    out = signs.select("doc_id", "n", "key").join(named, F.col("key") == F.col("k"), "left")
    own = F.when(F.col("key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "key")


def dedup(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    return judged(docs, threshold, **options).drop("key")


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the key of each text's set as a further column, and that column's name."""
    names = docs.columns
    key = fresh(names, "_key")

    def run(batches):
        for batch in batches:
            empty = pa.nulls(batch.num_rows, pa.int64())
            found = [r for part in signed([pa.RecordBatch.from_arrays([empty, batch.column(len(names))], ["doc_id", "text"])], "members") for r in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.binary())], [*names, key])

    rows = docs.select(*[F.col(f"`{n}`") for n in names], text_column().alias(fresh(names, "_filled")))
    return through(rows, run, StructType([*docs.schema.fields, StructField(key, BinaryType())])), key


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs with one row of each component, that of the smallest id; rows without shingles or id all stay.

    Rows are known by their ids, but for ids that several rows have: those are known by id and set.
    """
    work = options.pop("work", None) or Workspace(docs.sparkSession, "distinct")
    inner = Workspace(docs.sparkSession, "neardup")
    found = work.save(judged(docs, threshold, work=inner, **options).select("doc_id", "key", "kept"), "judged")
    inner.drop()
    work.release()
    again = work.save(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    out = docs.join(few(gone.unionByName(again).distinct()), "doc_id", "left_anti")
    if again.isEmpty():
        return out.select(*docs.columns)
    rows, key = keyed(docs.join(few(again), "doc_id", "left_semi").select(*docs.columns))
    stay = found.where("kept").select("doc_id", F.col("key").alias(key)).distinct()
    none = rows.where(F.col(key).isNull())
    one = rows.where(F.col(key).isNotNull()).join(stay, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return out.select(*docs.columns).unionByName(one.unionByName(none).select(*docs.columns))
