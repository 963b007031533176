"""Shared helpers: tables, the shared folder, and vectorised text handling on Arrow buffers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the bytes 0x09-0x0D.
WORD_REGEX = "[^\\x20\\x09-\\x0D]+"
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one vectorised step handles at a time; what a step needs besides is some dozens of times that.
STEP_BYTES = 1 << 18

#: Bytes that go to a Python worker at a time, and the setting that bounds them, with its default.
BATCH_BYTES = 4 << 20
_BATCH, _USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "67108864")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where the session names none, it is a temporary folder if Spark runs in one process, and otherwise one in the warehouse, which
    all executors see; never a machine-local folder on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if found is None:
        if spark.sparkContext._jsc.sc().isLocal():
            found = "file://" + tempfile.mkdtemp(prefix="dqspark-")
            atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_dqspark"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(names: list[str], base: str) -> str:
    """`base`, with underscores before it until no name is equal but for case."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base = "_" + base
    return base


def through(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH_BYTES, so that neither side of the pipe buffers many texts.

    The session's default becomes BATCH_BYTES for good; another size that a user has set stays. When a task ends,
    freed memory goes back to the system, as the worker process lives on for later tasks.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _USUAL[0]) in _USUAL:
        conf.set(_BATCH, str(BATCH_BYTES))

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return df.mapInArrow(wrapped, schema)


def hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


class Workspace:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/dqspark-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Let Spark delete shuffle files of finished steps: it does so once the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        """Delete one table, or all, by the file system that holds them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def seeded(df: DataFrame, key, n: int, total: int, seed: int, room: int = 4) -> DataFrame:
    """About room * n of `total` rows, by a hash of `key`, with it as _hash: few rows reach whoever takes the n least of them, however many partitions there are."""
    h = F.xxhash64(F.lit(seed), key).bitwiseAND(F.lit((1 << 31) - 1))
    cut = (1 << 31) if total <= room * n else (room * n * (1 << 31)) // total
    return df.withColumn("_hash", h).where(F.col("_hash") < cut)


def text_column(name: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a string array, and the offsets of each text in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, step: int = STEP_BYTES):
    """Ranges (i, j) of texts of together about `step` bytes; a longer text is alone in its range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors)
    return _powers["up"][:n], _powers["down"][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; the end of a text ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2**64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of data[start:end], whatever their place."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def long_hash(data: np.ndarray) -> np.uint64:
    """span_hashes of all of data, which may be of any length, in steps."""
    total = 0
    for at in range(0, len(data), STEP_BYTES):
        total += int(prefix_hashes(data[at : at + STEP_BYTES])[-1]) * pow(_BASE, at, 1 << 64)
    return mix64(np.array([(total + len(data)) & ((1 << 64) - 1)], np.uint64))[0]


def hashed_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR, prefix_bytes: int = 0):
    """(hash of each word, number of words of each text[, hash of each word's first bytes]) in order, in steps of bounded memory.

    A step ends at a separator or at the end of a text, so that no word is cut; a longer word is hashed by pieces.
    """
    starts, ends = word_bounds(data, offsets, separator)
    hashes, heads, i = np.zeros(len(starts), np.uint64), np.zeros(len(starts) if prefix_bytes else 0, np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP_BYTES, "right")))
        base, end = starts[i], ends[j - 1]
        if end - base > STEP_BYTES:  # one long word
            hashes[i] = long_hash(data[base:end])
            if prefix_bytes:
                heads[i] = long_hash(data[base : base + prefix_bytes])
        else:
            prefix = prefix_hashes(data[base:end])
            s, e = starts[i:j] - base, ends[i:j] - base
            hashes[i:j] = span_hashes(prefix, s, e)
            if prefix_bytes:
                heads[i:j] = span_hashes(prefix, s, np.minimum(e, s + prefix_bytes))
        i = j
    counts = np.diff(np.searchsorted(starts, offsets))
    return (hashes, counts, heads) if prefix_bytes else (hashes, counts)
