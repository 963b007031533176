"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters 16 bytes wide run at every fourth byte over overlapping chunks that together cover the
whole text. Each filter is max-pooled within a chunk; means and maxima over the chunks' pooled values go to a
small dense layer and one probability. Calibrated so that 0.3 is the best threshold on a
part of the sample that isn't trained on. Inputs are the text's bytes only.

Defined results: null and empty texts are scored as texts without chunks; a long text is convolved piece by piece, with
running sums and maxima of its chunks, so memory doesn't grow with it; rows that repeat, and texts that are equal, are scored alike; a
null id isn't held out; without labels of both classes every score is 1; an empty table gives no rows; of other columns
those named score and predicted make way for the results, and all others stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import buffers, fresh, slices, text_column, through
from .nets import Adam, calibrate, labelled_sample, packed, sigmoid

DIM, STRIDE, BLOCKS, FILTERS, HIDDEN = 8, 4, 4, 24, 16
#: Filter positions in a chunk and from one chunk's start to the next: 1,024 and 896 bytes.
CHUNK, HOP = 256, 224
#: Bytes that are convolved at a time, and chunks of a long text.
STEP, PIECE = 1 << 17, 128
#: Labelled rows of either class that are trained on at most, and the longest text among them.
ROWS_PER_CLASS, MAX_BYTES, EPOCHS, BATCH = 1500, 16_000, 8, 32
THRESHOLD = 0.3


def chunks_of(n):
    """Chunks of a text of n positions."""
    return np.where(n > 0, np.maximum(1, -(-(n - (CHUNK - HOP)) // HOP)), 0)


def filled(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How full each chunk is, 1 for a whole one."""
    return np.log1p(end - begin).astype(np.float32) / np.float32(np.log1p(CHUNK))


def pooled(y: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maxima of each filter in each chunk."""
    return np.maximum.reduceat(y, np.stack([begin, end], 1).ravel())[::2] if len(begin) else np.zeros((0, FILTERS), np.float32)


class Layout:
    """Texts laid out in steps of the stride, each followed by zeros as long as a filter, and their chunks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        self.n = -(-lengths // STRIDE)
        size = self.n + BLOCKS
        self.start = np.cumsum(size) - size
        self.bytes = np.zeros(int(size.sum()) * STRIDE, np.uint8)
        for s, a, b in zip((self.start * STRIDE).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            self.bytes[s : s + b - a] = data[a:b]
        self.chunks = chunks_of(self.n)
        self.doc = np.repeat(np.arange(len(lengths)), self.chunks)
        k = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.chunks) - self.chunks, self.chunks)
        self.begin = self.start[self.doc] + k * HOP
        self.end = np.minimum(self.begin + CHUNK, (self.start + self.n)[self.doc])
        self.fill = filled(self.begin, self.end)


class Net:
    def __init__(self, params: dict[str, np.ndarray], slope: float = 1.0, shift: float = 0.0):
        self.p, self.slope, self.shift = params, slope, shift

    def convolved(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the filters at all positions; the embedded bytes by blocks of the stride."""
        x = self.p["embed"][symbols].reshape(-1, STRIDE * DIM)
        y = x @ self.p["conv"][0]
        for o in range(1, BLOCKS):
            y[:-o] += x[o:] @ self.p["conv"][o]
        return y, x

    def activations(self, top: np.ndarray, fill: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(top + self.p["bias"], 0), fill[:, None]], 1)

    def document(self, lay: Layout, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the dense layer, which are mean and maximum over the chunks, and the chunks' activations."""
        a = self.activations(top, lay.fill)
        n, d = len(lay.n), FILTERS + 1
        out = np.zeros((n, 2 * d), np.float32)
        full = lay.chunks > 0
        if len(a):
            first = (np.cumsum(lay.chunks) - lay.chunks)[full]
            out[full, :d] = np.add.reduceat(a, first) / lay.chunks[full, None]
            out[full, d:] = np.maximum.reduceat(a, first)
        return out, a

    def long(self, data: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """document() of one text of any length, some chunks at a time."""
        n = -(-len(data) // STRIDE)
        chunks, d = chunks_of(n), FILTERS + 1
        total, most = np.zeros(d), np.full(d, -np.inf, np.float32)
        for k in range(0, int(chunks), piece):
            begin = np.arange(min(piece, chunks - k)) * HOP
            end = np.minimum(begin + CHUNK, n - k * HOP)
            symbols = np.zeros((int(end[-1]) + BLOCKS) * STRIDE, np.uint8)
            part = data[k * HOP * STRIDE :][: len(symbols)]
            symbols[: len(part)] = part
            a = self.activations(pooled(self.convolved(symbols)[0], begin, end), filled(begin, end))
            total += a.sum(0)
            most = np.maximum(most, a.max(0))
        return np.concatenate([total / chunks, most])[None].astype(np.float32)

    def logits(self, data: np.ndarray, offsets: np.ndarray, step: int = STEP) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for i, j in slices(offsets, step):
            if offsets[j] - offsets[i] > step:  # one long text
                out[i] = self.head(self.long(data[offsets[i] : offsets[j]]))[0][0]
                continue
            lay = Layout(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            top = pooled(self.convolved(lay.bytes)[0], lay.begin, lay.end)
            out[i:j] = self.head(self.document(lay, top)[0])[0]
        return out

    def head(self, v):
        h = np.maximum(v @ self.p["w1"] + self.p["b1"], 0)
        return h @ self.p["w2"] + self.p["b2"], h

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logits(data, offsets) + self.shift)


def train(texts: list[str], y: np.ndarray, langs: list[str], shares: np.ndarray, seed: int = 23, epochs: int = EPOCHS, threshold: float = THRESHOLD) -> Net | None:
    """Fit on four fifths of the rows and calibrate on the rest; None without both classes."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(y)) % 5 == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    p = {"embed": rng.normal(0, 1, (256, DIM)), "conv": rng.normal(0, 1 / np.sqrt(BLOCKS * STRIDE * DIM), (BLOCKS, STRIDE * DIM, FILTERS)), "bias": np.zeros(FILTERS), "w1": rng.normal(0, 0.2, (2 * FILTERS + 2, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embed"][0] = 0
    net, adam = Net(p), Adam(p, 0.005)
    data, offsets = packed(texts)
    rows = np.flatnonzero(~held)
    weight = np.where(y == 1, 0.5 / max((y[rows] == 1).sum(), 1), 0.5 / max((y[rows] == 0).sum(), 1)) * len(rows)
    d = FILTERS + 1
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(rows), max(1, len(rows) // BATCH)):
            part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in at])
            lay = Layout(part, np.concatenate([[0], np.cumsum(offsets[at + 1] - offsets[at])]))
            if not len(lay.doc):
                continue
            yv, x = net.convolved(lay.bytes)
            arg = np.stack([b + yv[b:e].argmax(0) for b, e in zip(lay.begin, lay.end)])
            top = yv[arg, np.arange(FILTERS)]
            v, a = net.document(lay, top)
            z, h = net.head(v)
            err = ((sigmoid(z) - y[at]) * weight[at] / len(at)).astype(np.float32)
            grads = {"w2": h.T @ err, "b2": np.array([err.sum()], np.float32)}
            dh = np.where(h > 0, err[:, None] * p["w2"], 0)
            grads["w1"], grads["b1"] = v.T @ dh + 1e-4 * p["w1"], dh.sum(0)
            dv = dh @ p["w1"].T
            da = (dv[:, :d] / np.maximum(lay.chunks, 1)[:, None])[lay.doc] + np.where(a == v[lay.doc, d:], dv[lay.doc, d:], 0)
            dt = np.where(a[:, :FILTERS] > 0, da[:, :FILTERS], 0).astype(np.float32)
            grads["bias"] = dt.sum(0)
            grads["conv"], de = np.zeros_like(p["conv"]), np.zeros_like(p["embed"])
            for o in range(BLOCKS):
                i = np.minimum(arg + o, len(x) - 1)
                grads["conv"][o] = np.einsum("cf,cfe->ef", dt, x[i])
                back = (dt[:, :, None] * p["conv"][o].T[None]).reshape(-1, STRIDE, DIM)
                symbols = lay.bytes.reshape(-1, STRIDE)[i.ravel()]
                np.add.at(de, symbols.ravel(), back.reshape(-1, DIM))
            de[0] = 0
            grads["embed"] = de
            adam.step(grads, 0.005 / (1 + 0.3 * epoch))
    z = net.logits(data, offsets)
    judged = held if held.any() else np.ones(len(y), bool)
    value = np.where(y == 1, shares[1] / max((y[judged] == 1).sum(), 1), shares[0] / max((y[judged] == 0).sum(), 1))
    net.slope, net.shift = calibrate(z[judged], y[judged], value[judged], threshold)
    return net


def fit(docs: DataFrame, labels: DataFrame, usable=None, rows_per_class: int = ROWS_PER_CLASS, max_bytes: int = MAX_BYTES, **options) -> Net | None:
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, rows_per_class, max_bytes)
    return train(*sample, **options)


def score(docs: DataFrame, net: Net | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns other than score and predicted, then score and predicted, for every row; docs has a text."""
    docs = docs.drop("score", "predicted")
    return scored(docs, net, "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scored(docs: DataFrame, net: Net | None, name: str) -> DataFrame:
    """All of docs' columns and the score as `name`, which is none of theirs."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data, offsets = buffers(part.column(len(names)))
                s = net.scores(data, offsets) if net else np.ones(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(s)], [*names, name])

    rows = docs.select(*[F.col(f"`{n}`") for n in names], text_column().alias(fresh(names, "_filled")))
    return through(rows, run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def keep(docs: DataFrame, net: Net | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows of quality, with all their columns, also those named score or predicted."""
    name = fresh(docs.columns, "_quality")
    return scored(docs, net, name).where(F.col(name) >= threshold).drop(name)
