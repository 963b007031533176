"""Predicates on the time axis and on physical partition columns; columns stay bare so files are pruned."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import STRFTIME
from ..functions.guards import identifier


def since(period: Column, first_day: date) -> Column:
    """Inclusive lower bound, no upper one."""
    return period >= F.lit(first_day)


def literal(day: date, fmt: str | None, is_integer: bool = False):
    """The day as a partition column has it: a date for no format, else text or an integer."""
    if fmt is None:
        return F.lit(day)
    text = day.strftime(STRFTIME.get(fmt, fmt))
    return F.lit(int(text)) if is_integer else F.lit(text)


def partition_since(columns: list[str], first_day: date, formats: dict[str, str | None], integers: dict[str, bool] | None = None) -> Column | None:
    """Lexicographic lower bound over the temporal partition columns, in order.

    Columns that `formats` doesn't name aren't temporal and take no part; None if none is left.
    """
    temporal = [identifier(c) for c in columns if c in formats]
    if not temporal:
        return None
    bound = {c: literal(first_day, formats[c], (integers or {}).get(c, False)) for c in temporal}
    cases = []
    for i, c in enumerate(temporal):
        last = i == len(temporal) - 1
        step = F.col(c) >= bound[c] if last else F.col(c) > bound[c]
        cases.append(reduce(lambda a, b: a & b, [F.col(x) == bound[x] for x in temporal[:i]] + [step]))
    return reduce(lambda a, b: a | b, cases)
