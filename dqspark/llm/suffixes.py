"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Every window of `length` bytes has an anchor: of the grams of GRAM bytes inside it, the one with the least hash,
the leftmost of ties. Equal windows have their anchors at the same place, so only suffixes that begin at anchors need
sorting. The windows of one anchor form a segment.

1. Anchors are dealt by gram. Of equal segments all but the first are removed whole. A segment whose gram no other segment
   has is unique; the rest, mostly the borders of repeats, go on.
2. For these, each task sorts the suffixes at its anchors, and exchanges the sorted run front-coded: the length of the
   prefix shared with the suffix before, and the bytes after it. Runs are cut between partitions at splitters of GRAM bytes.
3. Each partition merges its runs by a loser tree. The heads carry the length of the prefix they share with the last
   suffix put out; bytes known to be shared are never compared again. What comes out is in order, with the lengths of common prefixes.
4. A window is a piece of the left context and of the suffix. Ranges of the merged order give equal suffix pieces, the order of
   the left contexts gives equal left pieces; of windows equal in both, all but the first are removed.
5. Removed ranges are united by document.

Defined results: a null text is empty; texts shorter than `length` keep all bytes; of rows that repeat an id the order is that of
the text, and a null id is smaller than any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, buffers, mix64, powers, prefix_hashes, seeded, slices, span_hashes, text_column, through
from .neardup import _bounds, _grouped

LENGTH, GRAM = 100, 20
#: Bytes that one vectorised step looks at, and documents that splitters are taken from.
STEP, SPLIT_DOCS, SPLIT_CHARS = 1 << 18, 400, 20_000
_PLACE_BITS = np.uint64(20)
_PLACES = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(start, windows, anchor, gram's hash, segment's hash, text) of each segment of the texts; places are in data."""
    out = []
    for i, j in slices(offsets, STEP):
        a, b = int(offsets[i]), int(offsets[j])
        for at in range(a, max(a + 1, b - length + 1), STEP):
            # a long text goes in pieces; each has the windows that start in it
            end = min(b, at + STEP + length - 1) if j == i + 1 else b
            if end - at < length:
                continue
            found = _anchors(data[at:end], offsets[i : j + 1].clip(at, end) - at, length, gram)
            out.append((found[0] + at, found[1], found[2] + at, found[3], found[4], found[5] + i))
            if j > i + 1:
                break
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64)
    return [np.concatenate([o[k] for o in out]) if out else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def _anchors(data, offsets, length, gram):
    width = length - gram + 1
    prefix = prefix_hashes(data)
    _, down = powers(len(prefix))
    n = len(data) - gram + 1
    grams = mix64((prefix[gram:] - prefix[:-gram]) * down[:n])
    # hash above, place below: the least value is the leftmost of the least hashes
    packed = (grams & ~_PLACES) | np.arange(n, dtype=np.uint64)
    blocks = np.concatenate([packed, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - width + 1
    place = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _PLACES).astype(np.int64)
    whole = np.ones(windows, bool)
    for edge in offsets[1:-1].tolist():
        whole[max(0, edge - length + 1) : edge] = False
    start = np.flatnonzero(whole)
    anchor = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    start, anchor = start[first], anchor[first]
    segment = span_hashes(prefix, start, start + count - 1 + length)
    return start, count, anchor, grams[anchor], segment, np.searchsorted(offsets, start, "right") - 1


def ordered(docs: DataFrame, work: Workspace) -> DataFrame:
    """(uid, doc_id, text): uid grows with doc_id and names a row; it is doc_id where that is unique and never null."""
    rows = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    doubtful = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if doubtful.isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    return work.save(rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "ordered")


_MARK = "whole boolean, uid long, start int, windows int, anchor int"


def marks(rows: DataFrame, length: int, partitions: int) -> DataFrame:
    """Segments that are removed whole, and those that go on to the sort.

    Equal segments of one batch are settled where they are, so a text that very many rows share reaches its partition once a batch.
    """

    def emit(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            uid = batch.column(0).to_numpy()
            start, count, anchor, gram, segment, doc = anchors(data, offsets, length)
            base = offsets[doc]
            order = np.lexsort((start, uid[doc], segment, gram))
            again = np.zeros(len(order), bool)
            again[1:] = (gram[order][1:] == gram[order][:-1]) & (segment[order][1:] == segment[order][:-1])
            gone = np.zeros(len(order), bool)
            gone[order] = again
            # those settled are dealt at random, and so is no other row
            key = np.where(gone, mix64(segment + start.astype(np.uint64)), gram).view(np.int64)
            for at in range(0, len(order), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (key, segment.view(np.int64), uid[doc], (start - base).astype(np.int32), count.astype(np.int32), (anchor - base).astype(np.int32), gone)], ["key", "segment", "uid", "start", "windows", "anchor", "gone"])

    def settle(batches):
        for t in _grouped(batches, 1):
            key, segment, uid, start, count, anchor = (t.column(k).to_numpy() for k in range(6))
            gone = t.column(6).to_numpy(zero_copy_only=False)
            live = np.flatnonzero(~gone)
            same_key, same = np.zeros(len(live), bool), np.zeros(len(live), bool)
            same_key[1:] = key[live][1:] == key[live][:-1]
            same[1:] = same_key[1:] & (segment[live][1:] == segment[live][:-1])
            gone[live[same]] = True
            first = live[~same]
            cuts = _bounds(key[first]) if len(first) else np.zeros(1, np.int64)
            several = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
            pick = np.concatenate([np.flatnonzero(gone), first[several]])
            whole = np.arange(len(pick)) < gone.sum()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (whole, uid[pick], start[pick], count[pick], anchor[pick])], ["whole", "uid", "start", "windows", "anchor"])

    schema = "key long, segment long, uid long, start int, windows int, anchor int, gone boolean"
    found = through(rows.select("uid", "text"), emit, schema)
    return through(found.repartition(partitions, "key").sortWithinPartitions("key", "segment", "uid", "start"), settle, _MARK)


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of which `known` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, step = known, 8
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
    while a[lo] == b[lo]:
        lo += 1
    return lo


class Run:
    """A sorted run, front-coded: for each suffix the prefix shared with the one before, and the rest."""

    def __init__(self, blob: bytes):
        n, self.rest_size, self.left_size = struct.unpack_from("<3q", blob)
        self.n, at = n, 24
        self.columns = {}
        for name, kind in (("uid", "<i8"), ("anchor", "<i4"), ("low", "u1"), ("high", "u1"), ("shared", "u1"), ("size", "u1")):
            self.columns[name] = np.frombuffer(blob, kind, n, at)
            at += n * np.dtype(kind).itemsize
        self.rest, self.left = blob[at : at + self.rest_size], blob[at + self.rest_size : at + self.rest_size + self.left_size]

    @staticmethod
    def pack(suffixes: list[bytes], lefts: list[bytes], uid, anchor, low, high) -> bytes:
        shared = [0] + [shared_prefix(a, b, 0) for a, b in zip(suffixes, suffixes[1:])]
        rest = b"".join([s[k:] for s, k in zip(suffixes, shared)])
        left = b"".join(lefts)
        columns = [np.asarray(x, kind).tobytes() for x, kind in ((uid, "<i8"), (anchor, "<i4"), (low, "u1"), (high, "u1"), (shared, "u1"), ([len(s) for s in suffixes], "u1"))]
        return b"".join([struct.pack("<3q", len(suffixes), len(rest), len(left)), *columns, rest, left])

    def suffixes(self):
        """(shared, suffix) in order."""
        before, at = b"", 0
        for shared, size in zip(self.columns["shared"].tolist(), self.columns["size"].tolist()):
            before = before[:shared] + self.rest[at : at + size - shared]
            at += size - shared
            yield shared, before


def merge(runs: list) -> tuple[list[int], list[int]]:
    """Merged order of runs as (run of each suffix, prefix it shares with the one before).

    A tournament of losers. A head's `known` is the prefix it shares with the last suffix put out. Of two heads the one that
    shares more comes first, unseen; only if they share the same do their bytes decide, from there on, and the loser's
    `known` becomes the prefix it shares with the winner, which is put out before it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [iter(r) for r in runs]
    known, suffix = [-1] * k, [b""] * k
    for i, h in enumerate(heads):
        known[i], suffix[i] = next(h, (-1, b""))
    tree = [0] * (2 * k)

    def duel(a: int, b: int) -> tuple[int, int]:
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = suffix[a], suffix[b]
        n = shared_prefix(x, y, ka)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winner = list(range(k)) * 2
    for node in range(k - 1, 0, -1):
        won, lost = duel(winner[2 * node] if 2 * node < k else 2 * node - k, winner[2 * node + 1] if 2 * node + 1 < k else 2 * node + 1 - k)
        winner[node], tree[node] = won, lost
    top = winner[1] if k > 1 else 0
    out_run, out_shared = [], []
    while known[top] >= 0:
        out_run.append(top)
        out_shared.append(known[top])
        known[top], suffix[top] = next(heads[top], (-1, b""))
        node = (top + k) >> 1
        while node:
            won, lost = duel(top, tree[node])
            top, tree[node] = won, lost
            node >>= 1
    return out_run, out_shared


def _reversed_lefts(run: Run, width: int) -> np.ndarray:
    """Left contexts from the anchor backwards, one row each, padded with zeros."""
    size = run.columns["high"].astype(np.int64)
    out = np.zeros((run.n, width), np.uint8)
    row = np.repeat(np.arange(run.n), size)
    end = np.cumsum(size)
    data = np.frombuffer(run.left, np.uint8)
    out[row, end[row] - 1 - np.arange(len(data))] = data
    return out


def removed_windows(runs: list[Run], length: int, gram: int = GRAM):
    """(uid, start, end) of the ranges that repeated windows of a partition cover."""
    width = length - gram + 1
    order, shared = merge([r.suffixes() for r in runs])
    order, shared = np.array(order), np.array(shared, np.int64)
    n = len(order)
    where = np.empty(n, np.int64)
    first = np.concatenate([[0], np.cumsum([r.n for r in runs])])
    for i in range(len(runs)):
        where[order == i] = first[i] + np.arange(runs[i].n)
    uid, anchor, low, high = (np.concatenate([r.columns[c] for r in runs])[where].astype(np.int64) for c in ("uid", "anchor", "low", "high"))
    left = np.concatenate([_reversed_lefts(r, -(-width // 8) * 8) for r in runs])[where]
    words = np.ascontiguousarray(left).view(">u8").astype(np.uint64)
    by_left = np.lexsort(words.T[::-1])
    unlike = left[by_left][1:] != left[by_left][:-1]
    left_shared = np.where(unlike.any(1), unlike.argmax(1), left.shape[1])
    age = np.empty(n, np.int64)
    age[np.lexsort((anchor, uid))] = np.arange(n)
    gone = np.zeros((n, width), bool)
    same = np.empty(n, np.int64)
    for j in range(int(high.max(initial=-1)) + 1):
        right = np.cumsum(shared < length - j)
        same[by_left] = np.concatenate([[0], np.cumsum(left_shared < j)])
        active = np.flatnonzero((low <= j) & (high >= j))
        key = right[active] * (n + 1) + same[active]
        rank = np.lexsort((age[active], key))
        again = np.zeros(len(active), bool)
        again[1:] = key[rank][1:] == key[rank][:-1]
        gone[active[rank[again]], j] = True
    # neighbouring offsets of one anchor form one range
    edges = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, j0 = np.nonzero(edges == 1)
    _, j1 = np.nonzero(edges == -1)
    return uid[row], anchor[row] - (j1 - 1), anchor[row] - j0 + length


def sort_and_compare(rows: DataFrame, borders: DataFrame, length: int, partitions: int, gram: int = GRAM) -> DataFrame:
    """(uid, start, end) of ranges that repeat, from the segments that go on."""
    some = seeded(rows, F.col("uid"), SPLIT_DOCS, rows.count(), 7).where(F.octet_length("text").between(length, SPLIT_CHARS))
    sample = some.orderBy("_hash").limit(SPLIT_DOCS).select("text").toArrow()
    data, offsets = buffers(sample.column(0).combine_chunks()) if len(sample) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    raw = data.tobytes()
    grams = sorted({raw[a : a + gram] for a in anchors(data, offsets, length)[2].tolist()})
    splitters = [grams[len(grams) * i // partitions] for i in range(1, partitions)] if len(grams) >= partitions else grams

    def cut(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            raw = data.tobytes()
            per = batch.column(2)
            sizes = np.diff(per.offsets.to_numpy())
            start, count, anchor = (per.flatten().field(k).to_numpy().astype(np.int64) for k in range(3))
            uid = np.repeat(batch.column(0).to_numpy(), sizes)
            base = np.repeat(offsets[:-1], sizes)
            # offsets of the windows from the anchor: low to high
            high, low = anchor - start, anchor - start - count + 1
            at = (base + anchor).tolist()
            suffix = [raw[a : a + length - k] for a, k in zip(at, low.tolist())]
            order = sorted(range(len(suffix)), key=suffix.__getitem__)
            part = np.searchsorted(np.array(splitters, object), np.array([suffix[i][:gram] for i in order], object), "right") if splitters else np.zeros(len(order), np.int64)
            cuts = _bounds(part) if len(part) else np.zeros(1, np.int64)
            for s, e in zip(cuts[:-1], cuts[1:]):
                pick = order[s:e]
                blob = Run.pack([suffix[i] for i in pick], [raw[at[i] - int(high[i]) : at[i]] for i in pick], uid[pick], anchor[pick], low[pick], high[pick])
                yield pa.RecordBatch.from_arrays([pa.array([part[s]], pa.int32()), pa.array([blob], pa.binary())], ["part", "run"])

    def join(batches):
        held, now = [], None
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now and held:
                    yield from result(held)
                    held = []
                now = part
                held.append(Run(blob.as_py()))
        if held:
            yield from result(held)

    def result(runs):
        uid, start, end = removed_windows(runs, length, gram)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["uid", "start", "end"])

    per_doc = borders.groupBy("uid").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("segments"))
    runs = through(rows.select("uid", "text").join(per_doc, "uid").select("uid", "text", "segments"), cut, "part int, run binary")
    return through(runs.repartition(partitions, "part").sortWithinPartitions("part"), join, "uid long, start int, end int")


def united(ranges: DataFrame, partitions: int) -> DataFrame:
    """(uid, spans): the union of the ranges of each document, in order."""

    def unite(batches):
        for t in _grouped(batches, 1):
            uid, start, end = (t.column(k).to_numpy().astype(np.int64) for k in range(3))
            cuts = _bounds(uid)
            doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            # the furthest end so far within each document, by shifting documents apart
            far = np.maximum.accumulate(end + doc * (1 << 33)) - doc * (1 << 33)
            new = np.ones(len(uid), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(uid)) - 1
            owner = doc[first]
            sizes = np.bincount(owner, minlength=len(cuts) - 1)
            spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(far[last])], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([pa.array(uid[cuts[:-1]]), lists], ["uid", "spans"])

    rows = ranges.select("uid", "start", "end").repartition(partitions, "uid").sortWithinPartitions("uid", "start")
    return through(rows, unite, "uid long, spans array<struct<start: long, end: long>>")


def repeated_spans(rows: DataFrame, work: Workspace, length: int = LENGTH) -> DataFrame:
    """(uid, spans) of documents that lose bytes."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    found = work.save(marks(rows, length, parts), "marks")
    work.release()
    whole = found.where("whole").select("uid", "start", (F.col("start") + F.col("windows") + F.lit(length - 1)).alias("end"))
    more = work.save(sort_and_compare(rows, found.where("NOT whole"), length, parts), "more")
    work.release()
    spans = work.save(united(whole.unionByName(more), parts), "spans")
    work.release()
    work.drop("marks")
    return spans


def dedup(docs: DataFrame, length: int = LENGTH, work: Workspace | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary] for every row of docs(doc_id, text)."""
    work = work or Workspace(docs.sparkSession, "suffixes")
    rows = ordered(docs, work)
    spans = repeated_spans(rows, work, length)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, cuts in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw, kept, at = text.as_buffer(), [], 0
                view = memoryview(raw)
                for c in cuts.as_py() or ():
                    kept.append(view[at : c["start"]])
                    at = c["end"]
                kept = b"".join([*kept, view[at:]])
                row = (doc.as_py(), len(view), len(view) - len(kept), len(cuts.as_py() or ()), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_text else row)
                if len(out) >= 1000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    def table(out):
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return through(rows.join(spans, "uid", "left").select("doc_id", "text", "spans"), cut, schema)
