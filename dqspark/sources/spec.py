"""What to read and over which window: a specification that resolves to a DataFrame with a period."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, guards, sampling
from . import predicates

INCREMENTAL, FULL_SNAPSHOT, NON_PARTITIONED = "incremental", "full_snapshot", "non_partitioned"
MAX_LOOKBACK = 730


@dataclass(frozen=True)
class Grain:
    """Thresholds that depend on the length of a period."""

    name: str
    min_history: int
    windows: tuple[int, ...]
    robustness: tuple[tuple[int, float], ...]
    dynamic_periods: int
    possible_periods: int
    default_n: int
    seasonal: bool


#: Fixed values.
DAILY = Grain("daily", 7, (10, 15, 20, 30, 45), ((7, -0.30), (15, -0.15), (30, -0.05)), 10, 5, 30, True)
MONTHLY = Grain("monthly", 3, (3, 4, 5, 6, 8, 10, 12), ((3, -0.30), (5, -0.15), (8, -0.05)), 3, 2, 12, False)
GRAINS = {"daily": DAILY, "monthly": MONTHLY, "timestamp": DAILY, "custom": DAILY}


@dataclass(frozen=True)
class SourceSpec:
    """A table, its time axis, and the window that analyses look at.

    `table` is a catalog name, or a path with `fmt`. The axis is `date_expression`, else the first partition column of incremental
    and snapshot tables, else `date_column`, read by `date_format`. `partition_formats` names the temporal partition columns.
    """

    table: str
    fmt: str | None = None
    method: str = NON_PARTITIONED
    date_column: str | None = None
    date_format: str = "date"
    date_expression: str | None = None
    partition_columns: tuple[str, ...] = ()
    partition_formats: dict[str, str | None] = field(default_factory=dict)
    partition_integers: dict[str, bool] = field(default_factory=dict)
    grain: str = "daily"
    lookback: int = 90
    lookback_unit: str = "days"
    reference_day: str | None = None
    base_filter: str | None = None
    business_date: str | None = None
    sample_pct: float | None = None
    sample_seed: int = 42

    def __post_init__(self):
        guards.reference_day(self.reference_day)
        object.__setattr__(self, "lookback", max(1, min(int(self.lookback), MAX_LOOKBACK)))
        for name in (*self.partition_columns, *filter(None, [self.date_column])):
            guards.identifier(name)

    @property
    def policy(self) -> Grain:
        return GRAINS[self.grain]

    def fingerprint(self) -> str:
        """Twelve hex digits that change with anything that changes results."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]

    def period(self):
        if self.date_expression:
            day = F.expr(guards.expression(self.date_expression)).cast("date")
        elif self.method != NON_PARTITIONED and self.partition_columns:
            column = self.partition_columns[0]
            day = dates.as_day(F.col(column), self.partition_formats.get(column) or "date")
        elif self.date_column:
            day = dates.as_day(F.col(self.date_column), self.date_format)
        else:
            raise ValueError("no time axis")
        return dates.month_of(day) if self.grain == "monthly" else day

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.fmt).load(self.table) if self.fmt else spark.table(self.table)

    def resolve(self, spark: SparkSession, df: DataFrame | None = None, sampled: bool = False, segment: str | None = None) -> DataFrame:
        """Rows in the window, with a `period`. Filters come before the sample; sampling is for distributions only."""
        rows = df if df is not None else self.read(spark)
        first = dates.cutoff(self.lookback, self.reference_day)
        pruned = predicates.partition_since(list(self.partition_columns), first, self.partition_formats, self.partition_integers) if self.lookback_unit == "days" else None
        if pruned is not None:
            rows = rows.where(pruned)
        for text in (self.base_filter, segment):
            if clean := guards.filter_text(text):
                rows = rows.where(F.expr(clean))
        if self.business_date and self.business_date != self.date_column:
            rows = rows.where(predicates.since(dates.as_day(F.col(guards.identifier(self.business_date))), first))
        rows = rows.withColumn("period", self.period())
        if self.lookback_unit == "days":
            rows = rows.where(predicates.since(F.col("period"), first))
        else:
            recent = rows.select("period").where(F.col("period").isNotNull()).distinct().orderBy(F.col("period").desc()).limit(self.lookback)
            rows = rows.join(F.broadcast(recent), "period", "left_semi")  # at most MAX_LOOKBACK rows
        return sampling.bernoulli(rows, self.sample_pct, self.sample_seed) if sampled else rows

    def with_segment(self, condition: str) -> SourceSpec:
        """The same source restricted to a subpopulation."""
        parts = [f"({p})" for p in (guards.filter_text(self.base_filter), guards.filter_text(condition)) if p]
        return replace(self, base_filter=" AND ".join(parts))


def latest(df: DataFrame, per: str, by: str) -> DataFrame:
    """The rows of each `per` whose `by` is the largest."""
    w = Window.partitionBy(per).orderBy(F.col(by).desc())
    return df.withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")
