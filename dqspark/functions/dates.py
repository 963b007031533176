"""Time axes: expressions that turn a column into a day, format detection, cutoffs."""

from __future__ import annotations

import re
from collections import Counter
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Axis formats by name, as Spark patterns; integers and strings have their own lists.
STRING_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyyyMM", "dd/MM/yyyy", "timestamp")
INTEGER_FORMATS = ("yyyyMMdd", "yyyyMM", "epoch_s", "epoch_ms")
STRFTIME = {"yyyy-MM-dd": "%Y-%m-%d", "yyyyMMdd": "%Y%m%d", "yyyyMM": "%Y%m", "yyyy": "%Y", "MM": "%m", "dd": "%d"}
_SHAPES = (r"\d{4}-\d{2}-\d{2}$", r"\d{8}$", r"\d{6}$", r"\d{2}/\d{2}/\d{4}$", r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}")
SAMPLES = 5


def as_day(column: Column, fmt: str = "date") -> Column:
    """The day of a native date or timestamp ("date"), of text, or of an integer; null where it doesn't parse."""
    text = column.cast("string")
    if fmt == "date":
        return column.try_cast("date")
    if fmt == "timestamp":
        return F.to_date(column.try_cast("timestamp"))
    if fmt == "epoch_s":
        return F.to_date(F.timestamp_seconds(column.try_cast("long")))
    if fmt == "epoch_ms":
        return F.to_date(F.timestamp_millis(column.try_cast("long")))
    if fmt == "yyyyMM":
        return F.to_date(F.try_to_timestamp(F.concat(text, F.lit("01")), F.lit("yyyyMMdd")))
    return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))


def month_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def cutoff(lookback_days: int, reference: str | date | None = None) -> date:
    """First day of the window: the reference, or today, less the lookback; a literal when the plan is made."""
    day = date.fromisoformat(reference) if isinstance(reference, str) else reference or date.today()
    return day - timedelta(days=lookback_days)


def detect_format(samples: list[str], is_integer: bool) -> str:
    """The likeliest axis format of up to five values; the first of the list if none fits."""
    samples = [str(s).strip() for s in samples[:SAMPLES]]
    if is_integer:
        sizes = [len(s.replace(".0", "")) for s in samples if s.replace(".0", "").lstrip("-").isdigit()]
        size = Counter(sizes).most_common(1)[0][0] if sizes else 8
        return "yyyyMM" if size == 6 else "epoch_ms" if size >= 13 else "epoch_s" if size >= 10 else "yyyyMMdd"
    votes = Counter(next((i for i, p in enumerate(_SHAPES) if re.match(p, s)), -1) for s in samples)
    votes.pop(-1, None)
    return STRING_FORMATS[max(votes, key=lambda i: (votes[i], -i))] if votes else STRING_FORMATS[0]


def format_votes(df: DataFrame, column: str) -> DataFrame:
    """column, format, votes over all distinct values of a text column: detection as a query."""
    values = df.where(F.col(column).isNotNull()).select(F.trim(F.col(column).cast("string")).alias("v")).distinct()
    return values.groupBy(F.coalesce(_named(F.col("v")), F.lit("none")).alias("format")).agg(F.count("*").alias("votes")).withColumn("column_name", F.lit(column))


def _named(v: Column) -> Column:
    name = F.lit(None).cast("string")
    for shape, fmt in reversed(list(zip(_SHAPES, STRING_FORMATS))):
        name = F.when(v.rlike("^" + shape), fmt).otherwise(name)
    return name
