"""How row counts become rules: a protocol for strategies of one's own, and the dual guard that is used without one."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ..rules.ir import Guard
from ..sources.spec import DAILY, Grain
from . import proposals as PR


@runtime_checkable
class RowCountStrategy(Protocol):
    """Anything that makes proposals of a history(period, row_count), and makes them anew under another guard."""

    def propose(self, history: DataFrame, guard: Guard, grain: Grain) -> DataFrame: ...

    def recalculate(self, history: DataFrame, old: DataFrame, guard: Guard, grain: Grain) -> DataFrame: ...


class GenericBand:
    """A sigma band or a margin band around the mean of the last runs."""

    def propose(self, history: DataFrame, guard: Guard, grain: Grain = DAILY) -> DataFrame:
        return PR.row_count(history, guard, grain)

    def recalculate(self, history: DataFrame, old: DataFrame, guard: Guard, grain: Grain = DAILY) -> DataFrame:
        return self.propose(history, guard, grain).join(old.select("proposal_id"), "proposal_id", "left_semi")


def table_rules(history: DataFrame, guard: Guard = Guard(), grain: Grain = DAILY, strategy: RowCountStrategy | None = None) -> DataFrame:
    """Row count proposals by a strategy, scored and ranked."""
    strategy = strategy or GenericBand()
    if not isinstance(strategy, RowCountStrategy):
        raise TypeError("a strategy proposes and recalculates")
    return PR.recommended(strategy.propose(history, guard, grain), grain)
