"""What the trained classifiers share: labelled samples, Adam, and calibration. All numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import seeded, text_column


def fold(mod: int):
    """crc32 of the id as text, modulo `mod`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows_per_class: int, max_bytes: int, seed: int = 3):
    """(texts, labels, langs, share of each class among all usable labels) of at most rows_per_class rows of either class, in hash order.

    `usable` is a condition on doc_id. Longer texts than max_bytes aren't trained on. The rows come from a join whose
    small side holds 2 * rows_per_class rows, so it is broadcast whatever the tables' sizes. Of rows that repeat an id the
    one with the least text is taken, before anything reaches the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable).groupBy("doc_id").agg(F.max(label).alias("y"))
    shares = dict(known.groupBy("y").count().collect())
    chosen = None
    for y in (0, 1):
        part = seeded(known.where(F.col("y") == y), F.col("doc_id"), rows_per_class, shares.get(y, 0), seed).orderBy("_hash", "doc_id").limit(rows_per_class).drop("_hash")
        chosen = part if chosen is None else chosen.unionByName(part)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    body = docs.select("doc_id", text_column().alias("text"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang")).where(F.octet_length("text") <= max_bytes)
    known = body.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "y")).alias("r"))
    rows = sorted((r["doc_id"], *r["r"]) for r in known.collect())
    return [r[1] for r in rows], np.array([r[3] for r in rows], np.float64), [r[2] for r in rows], np.array([shares.get(0, 0), shares.get(1, 0)], np.float64)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= ((rate or self.rate) * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray, goal: str = "f1") -> float:
    """The logit halfway between two neighbours at which the weighted goal is greatest; ties to the widest gap."""
    order = np.argsort(-z)
    z, y, weight = z[order], y[order], weight[order]
    hit, said = np.cumsum(weight * y), np.cumsum(weight)
    miss = said - hit
    total, rest = hit[-1], miss[-1]
    value = 2 * hit / (said + total) if goal == "f1" else hit / max(total, 1e-9) - miss / max(rest, 1e-9)
    gap = np.append(z[:-1] - z[1:], 0.0)
    value = np.where(gap > 0, value, -np.inf)
    if not np.isfinite(value).any():
        return float(z.mean())
    best = np.flatnonzero(value >= value.max() - 1e-9)
    i = best[np.argmax(gap[best])]
    return float((z[i] + z[i + 1]) / 2)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, at: float, goal: str = "f1") -> tuple[float, float]:
    """Slope and shift of a sigmoid that is `at` where the goal is greatest, and steep enough to tell the two classes' medians apart."""
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    cut = best_threshold(z, y, weight, goal)
    spread = max(float(np.median(z[y == 1]) - np.median(z[y == 0])), 1e-3)
    slope = 8.0 / spread
    return slope, float(np.log(at / (1 - at)) - slope * cut)
