"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks, each of which runs on into its successor by an overlap. Every chunk is pre-tokenised on its own, from its
own first character, so a chunk's first pre-tokens may be wrong, as those at its end may. In the overlap the boundaries of both
neighbours are held against each other: the chunks are stitched at the first one that both have, so long as the characters on
either side are of classes at whose meeting a pre-token ends whatever stands before (:data:`SURE`). So boundaries hold in the whole text, and pieces between them are
encoded on their own. Neighbours without such a place in their overlap are one piece. Decoding concatenates the tokens' raw bytes.

Chunks of texts over `spread_chars` are rows, pre-tokenised and encoded by different tasks; only boundaries in overlaps, and
then tokens, meet by text. Shorter texts go through the same steps in one task.

Defined results: null and empty texts have no tokens; a run of one class of characters longer than the overlap stays one piece, however
long; null ids and repeated rows are rows like any other; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_column, through

CHUNK_CHARS, OVERLAP_CHARS = 1 << 14, 1 << 9
SPREAD_CHARS = 1 << 20
#: Texts that are encoded before their results are handed on.
BATCH_ROWS = 512
#: Between these a pre-token ends: a letter or digit and what is neither, or punctuation and white space. Only characters whose class
#: every Unicode version agrees on are named, since two libraries with tables of their own must agree.
SURE = regex.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿЀ-ҁぁ-ゖァ-ヺ一-鿿가-힣0-9])(?=[ \n!-/:-@\[-`{-~、。，])|(?<=[!-/:-@\[-`{-~])(?=[ \n])")


class Tokenizer:
    """Ranks from a file of base64 tokens with their ids, and the pattern that pre-tokenises."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = pattern
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode_piece(self, piece: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(piece, disallowed_special=()).astype("<u4", copy=False)

    def encode(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[np.ndarray]:
        return [self.encode_piece(p) for p in pieces(text, chunk, overlap, self.pattern)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def edges_of(part: str, chunk: int, overlap: int, inner: bool, pattern: str) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk, pre-tokenised on its own, in its overlap with the chunk before, if it is an inner one, and in that with the next.

    `part` is the chunk and its overlap with the next; boundaries count from where the overlap begins. The last one is where the
    chunk was cut off, and not one of the text.
    """
    found = [m.end() for m in regex.compile(pattern).finditer(part)][:-1]
    return [b for b in found if b < overlap and inner], [b - chunk for b in found if b >= chunk and SURE.match(part, b)]


def pieces(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, pattern: str = public_tokenizers.PATTERN) -> list[str]:
    """Pieces whose pre-tokens together are those of the text."""
    if len(text) <= chunk:
        return [text] if text else []
    edges = [edges_of(text[at : at + chunk + overlap], chunk, overlap, at > 0, pattern) for at in range(0, len(text), chunk)]
    cuts = [0, *(k * chunk + cut for k, cut in enumerate(stitched(edges), 1) if cut is not None), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def stitched(edges: list[tuple[list[int], list[int]]]) -> list[int | None]:
    """For each chunk but the first, where it is stitched to the one before: the first boundary that both have, from the overlap's beginning."""
    out = []
    for (_, tail), (head, _) in zip(edges, edges[1:]):
        own = set(head)
        out.append(next((b for b in tail if b in own), None))
    return out


@lru_cache(1)
def load(path: str, pattern: str) -> Tokenizer:
    with open(path, "rb") as f:
        return Tokenizer({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}, pattern)


def _rows(batch: pa.RecordBatch):
    """Row by row, so that few texts are Python strings at a time."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, spread_chars: int = SPREAD_CHARS, with_ids: bool = True, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256[, ids binary: little-endian unsigned 32-bit] for every row of docs(doc_id, text).

    The vocabulary is read by path on each executor; it is a fixed file of the installation.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")

    def summary(t: Tokenizer, parts):
        ids, n, sha, back = [], 0, hashlib.sha256(), hashlib.sha256()
        for part in parts:
            n += len(part)
            raw = part.tobytes()
            sha.update(raw)
            back.update(t.decode(part))
            if with_ids:
                ids.append(raw)
        return n, sha.hexdigest(), back.hexdigest(), b"".join(ids)

    def table(ids, rows):
        out = {"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "ids_sha256": pa.array([r[1] for r in rows], pa.string()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string())}
        return pa.RecordBatch.from_pydict(out | ({"ids": pa.array([r[3] for r in rows], pa.binary())} if with_ids else {}))

    def short(batches):
        t = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                yield table(part.column(0), [summary(t, t.encode(text, chunk, overlap)) for _, text in _rows(part)])

    def cut(batches):
        """A row per chunk of a long text: its own characters and the overlap."""
        for batch in batches:
            for doc, text in _rows(batch):
                uid = hashlib.sha256(f"{doc} ".encode() + text.encode()).digest()
                for k, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([uid], pa.binary()), pa.array([doc], pa.int64()), pa.array([k], pa.int32()), pa.array([text[at : at + chunk + overlap]], pa.string())], ["uid", "doc_id", "k", "part"])

    def pretokenised(batches):
        for batch in batches:
            for uid, k, part in _rows(batch):
                head, tail = edges_of(part, chunk, overlap, k > 0, pattern)
                yield pa.RecordBatch.from_arrays([pa.array([uid], pa.binary()), pa.array([k], pa.int32()), pa.array([head], pa.list_(pa.int32())), pa.array([tail], pa.list_(pa.int32()))], ["uid", "k", "head", "tail"])

    def cuts(batches):
        """Of each chunk, from where to where it has characters of its own, and the piece that these are in."""
        for batch in batches:
            for uid, edges in _rows(batch):
                edges = sorted({e["k"]: (e["head"], e["tail"]) for e in edges}.items())
                found = [0, *stitched([e for _, e in edges])]
                first = [0 if c is None else c for c in found]
                piece = np.cumsum([c is not None for c in found])
                last = [chunk + c for c in first[1:]] + [chunk + overlap]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([uid] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(piece, pa.int32())], ["uid", "k", "first", "last", "piece"])

    def encoded(batches):
        t = load(path, pattern)
        for batch in batches:
            for uid, doc, copies, piece, parts in _rows(batch):
                text = "".join(p["part"][p["first"] : p["last"]] for p in parts)
                yield pa.RecordBatch.from_arrays([pa.array([uid], pa.binary()), pa.array([doc], pa.int64()), pa.array([copies], pa.int64()), pa.array([piece], pa.int32()), pa.array([t.encode_piece(text).tobytes()], pa.binary())], ["uid", "doc_id", "copies", "piece", "raw"])

    def joined(batches):
        t = load(path, pattern)
        for batch in batches:
            for doc, copies, parts in _rows(batch):
                row = summary(t, (np.frombuffer(p["raw"], "<u4") for p in parts))
                for _ in range(copies):  # rows that repeat are encoded once
                    yield table([doc], [row])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    long = F.length("text") > spread_chars
    out = through(rows.where(~long), short, schema)
    if rows.where(long).isEmpty():
        return out
    work = work or Workspace(spark, "bpe")
    chunks = through(rows.where(long), cut, "uid binary, doc_id long, k int, part string")
    chunks = work.save(chunks.groupBy("uid", "doc_id", "k").agg(F.first("part").alias("part"), F.count("*").alias("copies")), "chunks")
    edges = through(chunks.select("uid", "k", "part").repartition(F.col("uid"), F.col("k")), pretokenised, "uid binary, k int, head array<int>, tail array<int>")
    places = through(edges.groupBy("uid").agg(F.collect_list(F.struct("k", "head", "tail")).alias("edges")), cuts, "uid binary, k int, first int, last int, piece int")
    parts = chunks.join(places, ["uid", "k"]).groupBy("uid", "doc_id", "copies", "piece").agg(F.array_sort(F.collect_list(F.struct("k", "part", "first", "last"))).alias("parts"))
    raw = through(parts.select("uid", "doc_id", "copies", "piece", "parts"), encoded, "uid binary, doc_id long, copies long, piece int, raw binary")
    whole = raw.groupBy("uid", "doc_id", "copies").agg(F.array_sort(F.collect_list(F.struct("piece", "raw"))).alias("parts")).select("doc_id", "copies", "parts")
    return out.unionByName(through(whole, joined, schema))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of every row of encoded(doc_id, ids); bytes that are no UTF-8 become replacement characters."""

    def back(batches):
        t = load(path, pattern)
        for batch in batches:
            texts = [t.decode(np.frombuffer(x.as_py() or b"", "<u4")).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return through(encoded.select(F.col("doc_id").cast("long"), "ids"), back, "doc_id long, text string")
