"""Sample sizes by Cochran's formula with finite-population correction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Fixed values.
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
MIN_POPULATION, MAX_ROWS, MIN_PCT, MAX_PCT = 50_000, 500_000, 0.1, 50.0


def sample_size(population: int, confidence: float = 0.95, margin: float = 0.05) -> int:
    if population <= 0:
        raise ValueError("a population is positive")
    if confidence not in Z:
        raise ValueError(f"confidence is one of {sorted(Z)}")
    if not 0.001 <= margin <= 0.5:
        raise ValueError("margin is 0.001 to 0.5")
    infinite = 0.25 * (Z[confidence] / margin) ** 2
    return max(1, math.ceil(infinite / (1 + (infinite - 1) / population)))


def sample_pct(population: int, confidence: float = 0.95, margin: float = 0.05) -> float | None:
    """Percent to sample, or None where sampling doesn't pay."""
    if population < MIN_POPULATION:
        return None
    pct = 100 * sample_size(population, confidence, margin) / population
    if pct > MAX_PCT:
        return None
    pct = max(pct, MIN_PCT)
    return round(min(pct, 100 * MAX_ROWS / population), 4)


def bernoulli(df: DataFrame, pct: float | None, seed: int = 42) -> DataFrame:
    """A Bernoulli sample of rows that are filtered already, so partitions are pruned first."""
    if pct is None:
        return df
    if not 0 < pct <= 100:
        raise ValueError("a sample is over 0 and up to 100 percent")
    return df.sample(False, pct / 100, seed)
