"""Parser of the rule language: boolean combinations of comparisons of a metric with arithmetic over past runs."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'[^']*')|(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<op>>=|<=|!=|=|>|<|\(|\)|\[|\]|,|\+|-|\*|/)|(?P<word>[A-Za-z_][A-Za-z0-9_.]*))""")
#: Metrics and how many columns they take.
METRICS = {"mean": 1, "standarddeviation": 1, "rowcount": 0, "completeness": 1, "distinctvaluescount": 1, "uniqueness": 1, "columnvalues": 1, "isprimarykey": None, "customsql": "sql"}


class RuleSyntaxError(ValueError):
    """Text that isn't a rule."""


@dataclass(frozen=True)
class Metric:
    """name in lower case; columns in lower case, or the SQL."""

    name: str
    args: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return ":".join((self.name, *self.args))


@dataclass(frozen=True)
class Past:
    """avg or std of the metric over the last n runs."""

    what: str
    n: int


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Compare:
    metric: Metric
    op: str
    value: object  # a number, Past or Arithmetic; for "in" a tuple of values


@dataclass(frozen=True)
class Bool:
    op: str
    parts: tuple


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RuleSyntaxError(f"unexpected {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0):
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else (None, "")

    def take(self, value: str | None = None):
        kind, got = self.peek()
        if kind is None or value is not None and got.lower() != value:
            raise RuleSyntaxError(f"expected {value or 'more'}, found {got!r}")
        self.at += 1
        return kind, got

    def has(self, word: str) -> bool:
        return self.peek()[1].lower() == word

    def disjunction(self):
        return self.chain("or", self.conjunction)

    def conjunction(self):
        return self.chain("and", self.atom)

    def chain(self, word, below):
        parts = [below()]
        while self.has(word):
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Bool(word, tuple(parts))

    def atom(self):
        if self.has("("):
            self.take()
            inside = self.disjunction()
            self.take(")")
            return inside
        return self.comparison()

    def comparison(self):
        kind, word = self.take()
        if kind != "word" or word.lower() not in METRICS:
            raise RuleSyntaxError(f"{word!r} is no metric")
        name = word.lower()
        takes = METRICS[name]
        if takes == "sql":
            metric = Metric(name, (self.take()[1][1:-1],))
        elif takes is None:
            columns = []
            while self.peek()[0] == "word" and self.peek()[1].lower() not in ("and", "or"):
                columns.append(self.take()[1].lower())
            return Compare(Metric(name, tuple(columns)), "=", 1.0)
        else:
            metric = Metric(name, tuple(self.column() for _ in range(takes)))
        _, op = self.take()
        if op.lower() == "in":
            return Compare(metric, "in", self.listed())
        if op.lower() == "between":
            low = self.sum()
            self.take("and")
            return Bool("and", (Compare(metric, ">=", low), Compare(metric, "<=", self.sum())))
        if op not in (">=", "<=", "=", "!=", ">", "<"):
            raise RuleSyntaxError(f"{op!r} is no comparison")
        return Compare(metric, op, self.sum())

    def column(self) -> str:
        kind, got = self.take()
        return (got[1:-1] if kind == "text" else got).lower()

    def listed(self) -> tuple:
        self.take("[")
        out = []
        while not self.has("]"):
            kind, got = self.take()
            if got == ",":
                continue
            sign = ""
            if got == "-":
                sign, (kind, got) = "-", self.take()
            out.append(None if kind == "word" and got.upper() == "NULL" else got[1:-1] if kind == "text" else sign + got)
        self.take("]")
        return tuple(out)

    def sum(self):
        return self.arithmetic(("+", "-"), self.product)

    def product(self):
        return self.arithmetic(("*", "/"), self.value)

    def arithmetic(self, ops, below):
        left = below()
        while self.peek()[1] in ops and self.peek()[0] == "op":
            left = Arithmetic(self.take()[1], left, below())
        return left

    def value(self):
        kind, got = self.take()
        if got == "(":
            inside = self.sum()
            self.take(")")
            return inside
        if got == "-":
            return Arithmetic("-", 0.0, self.value())
        if kind == "num":
            return float(got)
        if got.lower() in ("avg", "std"):
            self.take("(")
            self.take("last")
            self.take("(")
            n = int(float(self.take()[1]))
            self.take(")")
            self.take(")")
            return Past(got.lower(), n)
        raise RuleSyntaxError(f"unexpected {got!r}")


def parse(text: str):
    """The tree of a rule; raises RuleSyntaxError."""
    reader = _Reader(text)
    tree = reader.disjunction()
    if reader.at < len(reader.tokens):
        raise RuleSyntaxError(f"left over: {reader.peek()[1]!r}")
    return tree


def walk(tree):
    """All comparisons, in order."""
    if isinstance(tree, Bool):
        for part in tree.parts:
            yield from walk(part)
    else:
        yield tree


def spans_of(value) -> list[int]:
    """Numbers of past runs that a value looks at."""
    if isinstance(value, Past):
        return [value.n]
    if isinstance(value, Arithmetic):
        return spans_of(value.left) + spans_of(value.right)
    return []
