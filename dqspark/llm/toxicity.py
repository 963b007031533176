"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the rows of two tables, at the hash of the word and at the hash of its first
bytes, so inflected and compound words share one row. Filters of widths 1 to 3 run over all words of the text;
each filter's maximum goes to a logistic output. The tables start from the smoothed log odds of each bucket
among the labelled documents. The score is calibrated so that 0.7 is the best threshold on a part of the sample
that isn't trained on; thresholds by language are found there too and given beside the score, whose inputs are
the text's words only.

Defined results: null and empty texts are scored as texts without words; a long text is convolved piece by piece, each with the
last words of the one before, so memory doesn't grow with it; rows that repeat, and texts that are equal, are scored alike; a
null id isn't held out; without labels of both classes every score is 0; an empty table gives no rows; other columns than
doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, STEP_BYTES, buffers, hashed_words, slices, text_column, through
from .nets import Adam, best_threshold, calibrate, labelled_sample, packed, sigmoid

BUCKETS, DIM, WIDTHS, FILTERS, PREFIX_BYTES = 1 << 15, 10, (1, 2, 3), 8, 5
#: Labelled rows of either class that are trained on at most, and the longest text among them.
ROWS_PER_CLASS, MAX_BYTES, EPOCHS, BATCH = 2500, 24_000, 6, 64
THRESHOLD = 0.7
#: Words here are runs of ASCII letters and digits and all bytes over 0x7F.
SEPARATOR = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_AHEAD = max(WIDTHS) - 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of their beginnings, and the number of words of each text."""
    words, counts, heads = hashed_words(LOWER[data], offsets, SEPARATOR, PREFIX_BYTES)
    mask = np.uint64(BUCKETS - 1)
    return (words & mask).astype(np.int32), (heads & mask).astype(np.int32), counts


def pieces(data: np.ndarray, step: int):
    """(start, end) of pieces of about `step` bytes; a piece ends after a separator or at the end, so no word is cut."""
    at = 0
    while at < len(data):
        end = min(at + step, len(data))
        while end < len(data) and not SEPARATOR[data[end - 1]]:
            found = np.flatnonzero(SEPARATOR[data[end : end + step]])
            end = end + int(found[0]) + 1 if len(found) else min(end + step, len(data))
        yield at, end
        at = end


class Net:
    def __init__(self, params: dict[str, np.ndarray], slope: float = 1.0, shift: float = 0.0, thresholds: dict[str, float] | None = None):
        self.p, self.slope, self.shift, self.thresholds = params, slope, shift, thresholds or {}

    def pooled(self, a, b, counts):
        """Maximum of each filter over each text, and where it is. Texts are kept apart by rows of zeros."""
        p, n = self.p, int(counts.sum())
        gap = np.repeat(np.arange(len(counts)) * _AHEAD, counts)
        x = np.zeros((n + _AHEAD * len(counts), DIM), np.float32)
        rows = np.arange(n) + gap
        x[rows] = p["word"][a] + p["head"][b]
        starts = np.cumsum(counts + _AHEAD) - (counts + _AHEAD)
        out = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
        where = np.full(out.shape, -1, np.int64)
        full = counts > 0
        if not n:
            return out, where, x
        edges = np.stack([starts[full], starts[full] + counts[full]], 1).ravel()
        for k, width in enumerate(WIDTHS):
            w = p[f"conv{width}"]
            y = x @ w[0]
            for o in range(1, width):
                y[: len(x) - o] += x[o:] @ w[o]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(np.concatenate([y, y[-1:]]), edges)[::2]
            out[full, cols] = top + p[f"bias{width}"]
            if self.track:
                for d, s, c in zip(np.flatnonzero(full), starts[full], counts[full]):
                    where[d, cols] = s + y[s : s + c].argmax(0)
        return out, where, x

    track = False

    def long(self, data: np.ndarray, step: int) -> np.ndarray:
        """pooled() of one text of any length: by pieces that end at separators, each after the last words of the one before."""
        out = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
        held = np.zeros((0, DIM), np.float32)
        for at, end in pieces(data, step):
            a, b, counts = tokens(data[at:end], np.array([0, end - at]))
            x = np.concatenate([held, self.p["word"][a] + self.p["head"][b], np.zeros((_AHEAD if end == len(data) else 0, DIM), np.float32)])
            for k, width in enumerate(WIDTHS):
                n = len(x) - (_AHEAD if end == len(data) else width - 1)
                if n > 0:
                    w, cols = self.p[f"conv{width}"], slice(k * FILTERS, (k + 1) * FILTERS)
                    y = sum(x[o : o + n] @ w[o] for o in range(width))
                    out[cols] = np.maximum(out[cols], y.max(0) + self.p[f"bias{width}"])
            held = x[len(x) - min(_AHEAD, len(x)) :]
        return np.where(np.isfinite(out), out, 0)[None]

    def logits(self, data, offsets, step: int = STEP_BYTES) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for i, j in slices(offsets, step):
            part = data[offsets[i] : offsets[j]]
            if len(part) > step:  # one long text
                top = self.long(part, step)
            else:
                top = self.pooled(*tokens(part, offsets[i : j + 1] - offsets[i]))[0]
            out[i:j] = np.maximum(top, 0) @ self.p["out"] + self.p["out_bias"]
        return out

    def scores(self, data, offsets) -> np.ndarray:
        return sigmoid(self.slope * self.logits(data, offsets) + self.shift)


def _odds(buckets, doc, y, n_rows):
    """Smoothed log odds of a bucket's document frequency in the two classes, shrunk where it is rare."""
    pairs = np.unique(buckets.astype(np.int64) * n_rows + doc)
    bucket, label = pairs // n_rows, y[pairs % n_rows]
    pos, neg = (np.bincount(bucket[label == k], minlength=BUCKETS) for k in (1, 0))
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    return (np.log((pos + 2) / (n1 + 4)) - np.log((neg + 2) / (n0 + 4))).astype(np.float32)


def train(texts: list[str], y: np.ndarray, langs: list[str], shares: np.ndarray, seed: int = 11, epochs: int = EPOCHS, threshold: float = THRESHOLD) -> Net | None:
    """Fit on four fifths of the rows and calibrate on the rest; None without both classes."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(y)) % 5 == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    data, offsets = packed(texts)
    a, b, counts = tokens(data, offsets)
    first = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(y)), counts)
    use = ~held[doc]
    p = {"word": rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), "head": rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)}
    p["word"][:, 0] = _odds(a[use], doc[use], y, len(y))
    p["head"][:, 1] = _odds(b[use], doc[use], y, len(y))
    for width in WIDTHS:
        p[f"conv{width}"] = rng.normal(0, 0.3 / width, (width, DIM, FILTERS)).astype(np.float32)
        p[f"conv{width}"][0, :2] = np.abs(p[f"conv{width}"][0, :2]) + 0.2
        p[f"bias{width}"] = np.zeros(FILTERS, np.float32)
    p["out"], p["out_bias"] = rng.normal(0.1, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1, np.float32)
    net, dense = Net(p), [k for k in p if k not in ("word", "head")]
    net.track = True
    adam, rows = Adam({k: p[k] for k in dense}, 0.01), np.flatnonzero(~held)
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(rows), max(1, len(rows) // BATCH)):
            keep = [np.flatnonzero(rng.random(counts[d]) < 0.8) + first[d] for d in at]  # words drop out
            some = np.concatenate(keep) if keep else np.zeros(0, np.int64)
            ta, tb, tc = a[some], b[some], np.array([len(k) for k in keep])
            pre, where, x = net.pooled(ta, tb, tc)
            h = np.maximum(pre, 0)
            err = (sigmoid(h @ p["out"] + p["out_bias"]) - y[at]) / len(at)
            grads = {"out": (h.T @ err).astype(np.float32) + 1e-4 * p["out"], "out_bias": np.array([err.sum()], np.float32)}
            dh = np.where((pre > 0) & (where >= 0), err[:, None] * p["out"], 0)
            dx: dict[str, list] = {"i": [], "g": []}
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g, i = dh[:, cols].astype(np.float32), np.maximum(where[:, cols], 0)
                w = p[f"conv{width}"]
                grads[f"bias{width}"] = g.sum(0)
                grads[f"conv{width}"] = np.stack([np.einsum("df,dfe->ef", g, x[np.minimum(i + o, len(x) - 1)]) for o in range(width)]) + 1e-4 * w
                for o in range(width):
                    dx["i"].append((i + o).ravel())
                    dx["g"].append((g[:, :, None] * w[o].T[None]).reshape(-1, DIM))
            adam.step(grads, 0.01 / (1 + epoch))
            place = np.full(len(x) + _AHEAD, -1)
            place[np.arange(len(ta)) + np.repeat(np.arange(len(tc)) * _AHEAD, tc)] = np.arange(len(ta))
            at_word = place[np.concatenate(dx["i"])]
            real = at_word >= 0
            step = np.concatenate(dx["g"])[real] * -2.0
            np.add.at(p["word"], ta[at_word[real]], step)
            np.add.at(p["head"], tb[at_word[real]], step)
    net.track = False
    z = net.logits(data, offsets)
    judged = held if held.any() else np.ones(len(y), bool)
    weight = np.where(y == 1, shares[1] / max((y[judged] == 1).sum(), 1), shares[0] / max((y[judged] == 0).sum(), 1))
    net.slope, net.shift = calibrate(z[judged], y[judged], weight[judged], threshold)
    for lang in sorted(set(langs)):
        own = judged & (np.array(langs) == lang)
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= 20:
            net.thresholds[lang] = float(sigmoid(net.slope * best_threshold(z[own], y[own], weight[own]) + net.shift))
    return net


def fit(docs: DataFrame, labels: DataFrame, usable=None, rows_per_class: int = ROWS_PER_CLASS, max_bytes: int = MAX_BYTES, **options) -> Net | None:
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if usable is None else usable, rows_per_class, max_bytes)
    return train(*sample, **options)


def score(docs: DataFrame, net: Net | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, lang_threshold, lang_predicted for every row of docs(doc_id, text, lang)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data, offsets = buffers(part.column(1))
                s = net.scores(data, offsets) if net else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s)], ["doc_id", "lang", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"), F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"))
    scored = through(rows, run, "doc_id long, lang string, score double")
    own = F.lit(None).cast("double")
    for lang, cut in (net.thresholds if net else {}).items():
        own = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(own)
    own = F.coalesce(own, F.lit(threshold))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), own.alias("lang_threshold"), (F.col("score") >= own).cast("int").alias("lang_predicted"))
