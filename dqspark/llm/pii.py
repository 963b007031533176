"""Personal data: four base patterns, and a skip-chain conditional random field that adds what they miss.

Nodes are mentions: runs of digits with single separators, and words that hold an @. Neighbouring mentions
are linked in a chain; mentions that repeat (same digits, same last digits, or same address) are linked to
their next occurrence however distant, so a group of m copies has m - 1 links. Unary weights see a mention's
shape; chain and skip weights see its neighbours' labels. All are trained in numpy by pseudo-likelihood, with
the base matches as labels and their surface partly hidden, so that the skip links learn to carry a label to a
mention that is written otherwise. Inference is loopy sum-product over all nodes of a batch at once, until the messages
of each text stand still; base matches are fixed. A mention whose probability of a kind is at least `confidence` becomes a span of that kind.

Defined results: null and empty texts have no spans; a long text is one graph, whole; spans that begin together are in the order of
:data:`KINDS`, and where kinds tie the first is taken; null ids and repeated rows are rows like any other; an
empty table gives no rows; other columns, whatever their names, are ignored by :func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import seeded, slices, text_column, through

KINDS = ("email", "ip", "card", "phone")
_AT_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: One pass over each run of digits; only a match of the group counts.
_IP = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MENTION = re.compile(r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9])*+")
_ADDRESS = re.compile(r"[^\s@<>\"'(),;:]*@[^\s@<>\"'(),;:]*")
_DIGIT = re.compile("[0-9]")
_SPACES = re.compile(r"[^0-9]+")
#: Rows that the field is fitted on, and the longest text among them.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
CONFIDENCE = 0.9
#: Rounds of messages between two looks at which texts still change.
ROUNDS = 12


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches: the run of local characters before each @, then the domain."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _AT_LEFT:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if m[1] is not None and all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _SPACES.sub("", m[0]) if len(m[0]) >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def mentions(text: str) -> list[tuple[int, int]]:
    out = [m.span() for m in _ADDRESS.finditer(text) if len(m[0]) > 3] if "@" in text else []
    if _DIGIT.search(text):
        held = iter(sorted(out))
        block = next(held, None)
        for m in _MENTION.finditer(text):
            while block and block[1] <= m.start():
                block = next(held, None)
            if not block or m.end() <= block[0]:
                out.append(m.span())
    return sorted(out)


#: Of the features, those that describe how a mention is written; the rest describe what it holds.
N_FEATURES, SURFACE = 18, slice(9, 17)


def features(text: str, s: int, e: int) -> tuple[list[float], str]:
    """Shape of a mention, and the key that repeated or similar mentions share ("" for none)."""
    word = text[s:e]
    digits = _SPACES.sub("", word)
    n, mail = len(digits), "@" in word
    size = [n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n >= 20, n >= 14 and luhn(digits), mail, word.count(".") == 3 and not mail]
    look = [word[0] == "+", "(" in word, " " in word, "-" in word, "." in word, mail and "." in word.rpartition("@")[2], text[max(0, s - 1) : s].isalpha(), text[e : e + 1].isalpha()]
    key = "@" + word.lower().strip("._-+") if mail and len(word) >= 6 else digits[-9:] if n >= 9 else digits if n >= 7 else ""
    return [float(x) for x in (*size, *look, True)], key


class Graph:
    """Mentions of many texts with their chain and skip links, as arrays."""

    def __init__(self, texts, starts=None):
        x, kind, self.where, chain, skip = [], [], [], [], []
        self.base = []
        for doc, text in enumerate(texts):
            base = base_spans(text)
            self.base.append(base)
            last: dict[str, int] = {}
            before, i = -1, 0
            for s, e in mentions(text):
                while i < len(base) and base[i][2] <= s:
                    i += 1
                label = next((k + 1 for bs, k, be in base[i : i + 4] if bs < e and be > s), 0)
                f, key = features(text, s, e)
                at = len(x)
                x.append(f)
                kind.append(label)
                self.where.append((doc, s, e))
                if before >= 0:
                    chain.append((before, at))
                if key:
                    if key in last:
                        skip.append((last[key], at))
                    last[key] = at
                before = at
        self.x = np.array(x, np.float64).reshape(len(x), N_FEATURES)
        self.kind = np.array(kind, np.int64)
        self.chain, self.skip = (np.array(v, np.int64).reshape(len(v), 2) for v in (chain, skip))


def _neighbours(links: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, len(KINDS) + 1))
    for a, b in ((0, 1), (1, 0)):
        np.add.at(out, (links[:, a], kind[links[:, b]]), 1.0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(texts, seed: int = 5, steps: int = 300) -> dict[str, np.ndarray]:
    """Unary, chain and skip weights by pseudo-likelihood.

    Each mention counts as written, and again as a repeat of itself: its surface partly hidden, with a skip link to a
    mention of its own label. So a lone number is judged by its shape, and a repeated one by its neighbours' labels too.
    """
    g, labels = Graph(texts), len(KINDS) + 1
    n = len(g.kind)
    if not n:
        return {"unary": np.zeros((N_FEATURES, labels)), "chain": np.zeros((labels, labels)), "skip": np.zeros((labels, labels))}
    near, far = _neighbours(g.chain, g.kind, n), _neighbours(g.skip, g.kind, n)
    hidden = g.x.copy()
    hidden[:, SURFACE] *= np.random.default_rng(seed).random((n, SURFACE.stop - SURFACE.start)) < 0.5
    repeat = np.eye(labels)[g.kind]
    x = np.concatenate([np.concatenate([g.x, near, far], 1), np.concatenate([hidden, near, far + repeat], 1)])
    y = np.concatenate([g.kind, g.kind])
    share = np.bincount(y, minlength=labels).clip(1)
    weight = (1 / np.sqrt(share))[y]
    weight /= weight.sum()
    w, m, v, target = np.zeros((x.shape[1], labels)), 0.0, 0.0, np.eye(labels)[y]
    for t in range(1, steps + 1):
        grad = x.T @ ((_softmax(x @ w) - target) * weight[:, None]) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    a, b = w[N_FEATURES : N_FEATURES + labels], w[N_FEATURES + labels :]
    return {"unary": w[:N_FEATURES], "chain": (a + a.T) / 2, "skip": (b + b.T) / 2}


def marginals(g: Graph, model: dict[str, np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product; messages of all links of the batch go out together. Base matches are fixed.

    After every `rounds` rounds texts whose messages stand still are left out. A text without an equilibrium ends
    after four rounds a mention, by when a label has reached its last mention.
    """
    n, labels = len(g.kind), len(KINDS) + 1
    unary = g.x @ model["unary"]
    unary[g.kind > 0] = -50.0
    unary[np.flatnonzero(g.kind > 0), g.kind[g.kind > 0]] = 50.0
    links = np.concatenate([g.chain, g.chain[:, ::-1], g.skip, g.skip[:, ::-1]])
    is_skip = np.arange(len(links)) >= 2 * len(g.chain)
    half = np.concatenate([np.arange(len(g.chain)) + len(g.chain), np.arange(len(g.chain)), 2 * len(g.chain) + len(g.skip) + np.arange(len(g.skip)), 2 * len(g.chain) + np.arange(len(g.skip))])
    near, far = (np.exp(model[k] - model[k].max()) for k in ("chain", "skip"))
    message = np.zeros((len(links), labels))
    doc = np.array([d for d, _, _ in g.where], np.int64)
    of = doc[links[:, 0]]  # the text of each link
    left = rounds + 4 * np.bincount(doc)
    live, step = np.arange(len(links)), max(1, rounds)
    while len(live):
        nodes, ends = np.unique(links[live], return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        place = np.zeros(len(links), np.int64)
        place[live] = np.arange(len(live))
        back, own, by_skip, m = place[half[live]], unary[nodes], is_skip[live, None], message[live]
        for _ in range(step):
            belief = own.copy()
            np.add.at(belief, b, m)
            out = belief[a] - m[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.where(by_skip, out @ far, out @ near) + 1e-30)
            new -= new.max(1, keepdims=True)
            change = np.abs(new - m).max(1)
            m = 0.5 * m + 0.5 * new
        message[live] = m
        left -= step
        moving = np.zeros(len(left), bool)
        moving[of[live[change >= 1e-4]]] = True
        live = live[(moving & (left > 0))[of[live]]]
    belief = unary.copy()
    np.add.at(belief, links[:, 1], message)
    return _softmax(belief) if n else belief


def spans(texts, model: dict[str, np.ndarray], confidence: float = CONFIDENCE) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    g = Graph(texts)
    out = [(base, list(base)) for base in g.base]
    p = marginals(g, model)
    for i in np.flatnonzero((g.kind == 0) & (p[:, 1:].max(1, initial=0.0) >= confidence)):
        doc, s, e = g.where[i]
        out[doc][1].append((s, int(p[i, 1:].argmax()), e))
    return [(base, sorted(every)) for base, every in out]


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, seed: int = 5) -> dict[str, np.ndarray]:
    """Train on at most `rows` texts of at most `chars` characters that hold a digit or an @, chosen by hash."""
    some = seeded(docs.select("text"), F.col("text"), rows, docs.count(), seed, room=8)
    sample = some.where((F.length("text") <= chars) & F.col("text").rlike("[0-9]{4}|@"))
    return train([r["text"] for r in sample.orderBy("_hash", "text").limit(rows).collect()], seed)


def find(docs: DataFrame, model: dict | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs(doc_id, text)."""
    model = model or fit(docs)

    def run(batches):
        for batch in batches:
            for part in _parts(batch, 1):
                rows = spans(part.column(1).to_pylist(), model, confidence)
                counts = [pa.array([sum(k == i for _, k, _ in base) for base, _ in rows], pa.int64()) for i in range(len(KINDS))]
                sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, sha, pa.array([joined(every) for _, every in rows], pa.string())], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return through(docs.select(F.col("doc_id").cast("long"), text_column().alias("text")), run, schema)


def _parts(batch: pa.RecordBatch, column: int, step: int = 1 << 20):
    """A batch in parts of about `step` bytes of text."""
    c = batch.column(column)
    ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) if c.type == pa.string() else np.arange(len(c) + 1) * 4096
    for i, j in slices(ends, step):
        yield batch.slice(i, j - i)


def masked(text: str, every: list[tuple[int, int, int]]) -> str:
    """Each span, with those that overlap it, becomes its first kind's name in brackets."""
    out, at = [], 0
    for s, k, e in every:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """docs with every span of text replaced by its kind, and n_chars, where there is one, counted anew for changed rows."""
    model = model or fit(docs)
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            for part in _parts(batch, at):
                texts = part.column(at).to_pylist()
                found = spans([t or "" for t in texts], model, confidence)
                new = [masked(t, every) if t and every else t for t, (_, every) in zip(texts, found)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.column(at).type)
                if size is not None:
                    columns[size] = pa.array([len(b) if a != b else c for a, b, c in zip(texts, new, part.column(size).to_pylist())], part.column(size).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return through(docs, run, docs.schema)
