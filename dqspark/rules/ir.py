"""Rules before they are text: frozen specifications, each of which renders and evaluates."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

MEAN, STDDEV, ROW_COUNT = "MEAN_DUAL_GUARD", "STDDEV_DUAL_GUARD", "ROW_COUNT_DUAL_GUARD"
COMPLETENESS, ALLOWED, DISTINCT, DISTINCT_RANGE, PRIMARY_KEY = "COMPLETENESS", "ALLOWED_VALUES", "DISTINCT_COUNT_EXACT", "DISTINCT_COUNT_RANGE", "IS_PRIMARY_KEY"
FREQ_STATIC, FREQ_DYNAMIC, FREQ_HYBRID = "CATEGORY_FREQUENCY_STATIC", "CATEGORY_FREQUENCY_DYNAMIC", "CATEGORY_FREQUENCY_HYBRID"
PERCENTILE, UNIQUENESS, CUSTOM = "NUMERIC_PERCENTILE_BAND", "UNIQUENESS_CUSTOM_SQL", "CUSTOM_SQL"
RULE_TYPES = (MEAN, STDDEV, ROW_COUNT, COMPLETENESS, ALLOWED, DISTINCT, DISTINCT_RANGE, FREQ_STATIC, FREQ_DYNAMIC, FREQ_HYBRID, PERCENTILE, PRIMARY_KEY, UNIQUENESS, CUSTOM)
DYNAMIC_TYPES = (MEAN, STDDEV, ROW_COUNT, FREQ_DYNAMIC, FREQ_HYBRID, PERCENTILE)
SIMPLE_TYPES = (COMPLETENESS, ALLOWED, DISTINCT, DISTINCT_RANGE, PRIMARY_KEY)

#: How far each rule type has been tried in the job that runs rules.
VALIDATED, EXPERIMENTAL, UNKNOWN = "validated", "experimental", "unknown"
CAPABILITY = dict.fromkeys(RULE_TYPES, VALIDATED)


def capability(rule_type: str) -> str:
    """validated, experimental, or unknown for types that nothing is known of."""
    return CAPABILITY.get(rule_type, UNKNOWN)


@dataclass(frozen=True)
class Guard:
    """The dual guard: a sigma band or, if enabled, a margin band, around the mean of the last n runs."""

    n: int = 30
    k: float = 2.0
    margin: float = 0.10
    margin_enabled: bool = True
    buffer: float = 0.01
    floor: float = 0.0
    ceiling: float = 100.0

    def __post_init__(self):
        if self.floor > self.ceiling:
            raise ValueError("the floor is above the ceiling")


@dataclass(frozen=True)
class Rule:
    """What a rule checks. `values` are allowed values, key columns, or the quantile of a percentile rule."""

    rule_type: str
    column: str | None = None
    guard: Guard = field(default_factory=Guard)
    lower: float | None = None
    upper: float | None = None
    values: tuple[str, ...] = ()
    category: str | None = None
    column_type: str = "string"

    def __post_init__(self):
        if self.rule_type not in RULE_TYPES:
            raise ValueError(f"unknown rule type {self.rule_type!r}")

    def with_overrides(self, **changes) -> Rule:
        """A user's changes: n, k, margin, margin_enabled, floor, ceiling go to the guard, the rest to the rule; None changes nothing."""
        changes = {k: v for k, v in changes.items() if v is not None}
        guard = {k: changes.pop(k) for k in ("n", "k", "margin", "margin_enabled", "floor", "ceiling") if k in changes}
        return replace(self, guard=replace(self.guard, **guard), **changes)
