"""Validation of text that becomes SQL: identifiers, expressions, filters, literals."""

from __future__ import annotations

import math
import re

from pyspark.errors import ParseException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words and marks that a user's fragment must not contain.
BLOCKED_WORDS = ("ALTER", "CREATE", "DELETE", "DROP", "EXEC", "GRANT", "INSERT", "MERGE", "REVOKE", "SELECT", "TRUNCATE", "UNION", "UPDATE")
BLOCKED_MARKS = ("--", "/*", ";")
LOOKBACK_MAX_DAYS, LOOKBACK_MAX_PERIODS = 365, 100

_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
_WORD = re.compile(r"\b(" + "|".join(BLOCKED_WORDS) + r")\b", re.IGNORECASE)


class UnsafeText(ValueError):
    """A name, expression or filter that isn't allowed."""


def identifier(name: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise UnsafeText(f"not an identifier: {name!r}")
    return name


def quoted(name: str) -> str:
    return f"`{identifier(name)}`"


def parsed(text: str) -> str:
    """Text that Spark's own parser takes for one expression; without a session only its brackets are counted."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        if text.count("(") != text.count(")"):
            raise UnsafeText("unbalanced brackets")
        return text
    try:
        spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except ParseException as e:
        raise UnsafeText(f"not an expression: {str(e).splitlines()[0]}") from None
    return text


def expression(text: str) -> str:
    """A scalar expression without statements, comments or subqueries."""
    clean = (text or "").strip()
    bad = [m for m in BLOCKED_MARKS if m in clean] + [w.upper() for w in _WORD.findall(clean)]
    if bad or not clean:
        raise UnsafeText(f"not allowed: {', '.join(bad)}" if bad else "empty expression")
    return parsed(clean)


def filter_text(text: str | None) -> str:
    """An optional condition; an empty one stays empty."""
    return expression(text) if text and text.strip() else ""


def reference_day(text: str | None) -> str | None:
    if text and not _DAY.fullmatch(text):
        raise UnsafeText(f"not a yyyy-MM-dd day: {text!r}")
    return text or None


def lookback(value: int, unit: str = "days") -> int:
    top = LOOKBACK_MAX_DAYS if unit == "days" else LOOKBACK_MAX_PERIODS
    if not isinstance(value, int) or not 1 <= value <= top:
        raise UnsafeText(f"a lookback is 1 to {top} {unit}")
    return value


def number(value) -> int | float:
    """An integer if the value reads as one, else a finite float."""
    try:
        return int(str(value).strip())
    except ValueError:
        pass
    try:
        out = float(str(value).strip())
    except ValueError:
        raise UnsafeText(f"not a number: {value!r}") from None
    if not math.isfinite(out):
        raise UnsafeText(f"not finite: {value!r}")
    return out


def equals(column: str, value, numeric: bool = False) -> Column:
    """column = value as a typed comparison; nothing is spliced into SQL text."""
    return F.col(identifier(column)) == F.lit(number(value) if numeric else str(value))


def equals_text(column: str, value, numeric: bool = False) -> str:
    """The same as text, for rules that are shipped elsewhere."""
    name = identifier(column)
    if numeric:
        return f"{name} = {number(value)}"
    return f"{name} = '" + str(value).replace("'", "''") + "'"
