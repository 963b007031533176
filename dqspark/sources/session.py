"""Around queries: a log with a cost model, a cost guard, timeouts by size, and presets on disk."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Dollars per TB scanned by region, the least that a query counts as, and limits.
PRICE, PRICES, LEAST_BYTES = 5.0, {"sa-east-1": 9.0}, 10_000_000
WARN_USD, STOP_USD = 0.50, 3.00
TIMEOUTS = ((500_000_000, 600), (100_000_000, 360), (10_000_000, 240))
DEFAULT_TIMEOUT = 120
TTL = {"metadata": 3600, "profiling": 1800, "history": 900}
#: Rows of a result that are kept at most; larger ones are asked for again.
CACHED_ROWS = 100_000
LOG = "at double, name string, dataset string, column_name string, ms long, rows long, bytes long, cost_usd double, status string, cached boolean"
_FILE = re.compile(r"[A-Za-z0-9_\-]{1,80}")


class CostLimit(RuntimeError):
    """The session has spent what it may."""


def cost(scanned: int, region: str = "") -> float:
    return max(scanned, LEAST_BYTES) / 1e12 * PRICES.get(region, PRICE)


def timeout_for(rows: int) -> int:
    return next((t for n, t in TIMEOUTS if rows >= n), DEFAULT_TIMEOUT)


def planned_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of what a plan reads: a pre-flight figure, not a measurement."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class QuerySession:
    """Runs actions under a log, a cost guard and a timeout."""

    def __init__(self, spark: SparkSession, region: str = "", stop_usd: float = STOP_USD):
        self.spark, self.region, self.stop_usd, self.bypass, self.entries, self.results = spark, region, stop_usd, False, [], {}

    @property
    def spent(self) -> float:
        return sum(e["cost_usd"] for e in self.entries)

    def warning(self) -> bool:
        return self.spent >= WARN_USD

    def reset(self) -> None:
        self.entries = []

    @contextmanager
    def limited(self, seconds: int):
        """Cancels the jobs of this block after so many seconds."""
        group, sc = uuid.uuid4().hex, self.spark.sparkContext
        sc.setJobGroup(group, "dqspark", interruptOnCancel=True)
        timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
        timer.start()
        try:
            yield
        finally:
            timer.cancel()
            sc._jsc.sc().clearJobGroup()

    def collect(self, df: DataFrame, name: str, dataset: str = "", column: str = "", rows: int = 0) -> list:
        if self.spent >= self.stop_usd and not self.bypass:
            raise CostLimit(f"{self.spent:.2f} of {self.stop_usd:.2f} USD spent")
        began, scanned = time.time(), planned_bytes(df)
        entry = {"at": began, "name": name, "dataset": dataset, "column_name": column, "ms": 0, "rows": 0, "bytes": scanned, "cost_usd": cost(scanned, self.region), "status": "ok", "cached": df.is_cached}
        try:
            with self.limited(timeout_for(rows)):
                out = df.collect()
            entry["rows"] = len(out)
            return out
        except Exception as e:
            entry["status"] = "error"
            raise RuntimeError(f"query {name!r} on {dataset or 'a DataFrame'} failed: {str(e)[:500]}") from e
        finally:
            entry["ms"] = int((time.time() - began) * 1000)
            self.entries.append(entry)

    def frame(self, sql: str, name: str = "", **views: DataFrame) -> DataFrame:
        """The result of SQL text over DataFrames, named in it as {name}; nothing runs until it is asked for."""
        return self.spark.sql(sql, **views)

    def cached(self, key: str, kind: str, df: DataFrame, name: str, **about) -> list:
        """collect(), or what it gave for the same key not longer ago than the kind's time to live; the key is a source's fingerprint and what is asked of it."""
        at, out = self.results.get((kind, key), (0.0, None))
        if out is not None and time.time() - at < TTL[kind]:
            self.entries.append({"at": time.time(), "name": name, "dataset": about.get("dataset", ""), "column_name": about.get("column", ""), "ms": 0, "rows": len(out), "bytes": 0, "cost_usd": 0.0, "status": "ok", "cached": True})
            return out
        out = self.collect(df, name, **about)
        if len(out) <= CACHED_ROWS:
            self.results[kind, key] = (time.time(), out)
        return out

    def log(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(e.values()) for e in self.entries], LOG)

    def save_log(self, path: str) -> None:
        self.log().coalesce(1).write.mode("overwrite").json(path)


class Presets:
    """Named JSON documents in one folder of the driver: configuration, not data."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, name: str) -> Path:
        if not _FILE.fullmatch(name):
            raise ValueError(f"not a preset name: {name!r}")
        return self.folder / f"{name}.json"

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))

    def save(self, name: str, config: dict, profiles: list[dict] = ()) -> None:
        self._path(name).write_text(json.dumps({"config": config, "profiles": list(profiles), "uses": 0}, indent=1, sort_keys=True, default=str))

    def load(self, name: str) -> dict:
        return json.loads(self._path(name).read_text())

    def clone(self, name: str, to: str) -> None:
        found = self.load(name)
        self.save(to, found["config"], found["profiles"])

    def mark_used(self, name: str) -> None:
        found = self.load(name)
        found["uses"] += 1
        self._path(name).write_text(json.dumps(found, indent=1, sort_keys=True))

    def delete(self, name: str) -> None:
        self._path(name).unlink(missing_ok=True)

    def compare(self, a: str, b: str) -> dict[str, tuple]:
        """Fields of the configurations that differ."""
        x, y = self.load(a)["config"], self.load(b)["config"]
        return {k: (x.get(k), y.get(k)) for k in sorted({*x, *y}) if x.get(k) != y.get(k)}
