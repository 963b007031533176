"""Series operators against plain Python formulae on seeded series, and their edge cases."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from dqspark.operators import backtest as BT
from dqspark.operators import regime as R
from dqspark.operators import series as S
from dqspark.operators import tune as T

START = dt.date(2025, 1, 1)


def rows(name, values):
    return [(name, i, START + dt.timedelta(i), v) for i, v in enumerate(values)]


def frame(spark, **named):
    data = [r for name, values in named.items() for r in rows(name, values)]
    return spark.createDataFrame(data, "series_id string, idx int, period date, value double")


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(42)
    return {
        "stable": [r.gauss(100, 5) for _ in range(30)], "drift": [50 + 2 * i + r.gauss(0, 2) for i in range(30)], "break": [r.gauss(50, 5) for _ in range(15)] + [r.gauss(200, 5) for _ in range(15)],
        "season": [100 + 40 * math.sin(2 * math.pi * i / 7) + r.gauss(0, 3) for i in range(56)], "sparse": [None if i % 5 < 2 else r.gauss(100, 5) for i in range(30)], "zero": [0.0 if i % 5 < 3 else abs(r.gauss(50, 20)) for i in range(30)],
        "volatile": [r.gauss(100, 50) for _ in range(45)], "flat": [0.05] * 30, "short": [1.0, 2.0], "empty": [None] * 8,
    }


def by_id(df):
    return {r["series_id"]: r for r in df.collect()}


def test_regimes(spark, shapes):
    found = by_id(R.series_profile(frame(spark, **shapes)))
    assert found["stable"]["regime"] == "STABLE"
    assert found["drift"]["regime"] in ("TRENDING", "STRUCTURAL_BREAK") and found["drift"]["has_trend"]
    assert found["break"]["regime"] == "STRUCTURAL_BREAK" and found["break"]["n_post"] >= 5
    assert found["season"]["is_seasonal"] and found["sparse"]["is_sparse"] and found["zero"]["is_zero_inflated"] and found["volatile"]["is_volatile"]
    assert found["short"]["regime"] == "STABLE" and found["empty"]["is_sparse"]


def test_rolling_points_match_a_loop(spark, shapes):
    n, k, margin = 10, 2.0, 0.10
    got = {(r["series_id"], r["idx"]): r["passed"] for r in BT.dual_guard(frame(spark, **shapes), n, k, margin).collect()}
    want = {}
    for name, values in shapes.items():
        if sum(v is not None for v in values) < 7:
            continue
        for i, v in enumerate(values):
            base = [x for x in values[max(0, i - n) : i] if x is not None]
            if v is None or len(base) < 7:
                continue
            m, s = statistics.fmean(base), statistics.stdev(base)
            want[name, i] = abs(v - m) <= k * s + 1e-9 or abs(v - m) <= abs(m) * margin + 1e-9
    assert got == want


def test_streaks_match_a_loop(spark, shapes):
    points = BT.dual_guard(frame(spark, **shapes), 10, 1.0, 0.01)
    flags = {}
    for r in sorted(points.collect(), key=lambda r: r["idx"]):
        flags.setdefault(r["series_id"], []).append(r["passed"])
    for name, r in by_id(BT.streaks(points)).items():
        best = {True: 0, False: 0}
        run, last = 0, None
        for p in flags[name]:
            run = run + 1 if p == last else 1
            last = p
            best[p] = max(best[p], run)
        assert (r["max_pass_streak"], r["max_fail_streak"], r["current_streak_length"]) == (best[True], best[False], run)


def test_change_points_match_a_loop(spark, shapes):
    got = {k: r["change_idx"] for k, r in by_id(S.change_points(frame(spark, **shapes))).items()}
    for name, values in shapes.items():
        at, v = zip(*[(i, x) for i, x in enumerate(values) if x is not None]) if any(x is not None for x in values) else ((), ())
        want = None
        if len(v) >= 10 and statistics.stdev(v) > 1e-12:
            m, sd, pos, neg, alarms = statistics.fmean(v), statistics.stdev(v), 0.0, 0.0, []
            for i, x in enumerate(v):
                z = (x - m) / sd
                pos, neg = max(0.0, pos + z - 0.5), max(0.0, neg - z - 0.5)
                if max(pos, neg) > 4:
                    alarms.append(i)
                    pos = neg = 0.0
            kept, prev = [], 0
            for a in alarms:
                if a - prev >= 5:
                    kept.append(a)
                    prev = a
            kept = [a for a in kept if len(v) - a >= 5]
            if kept:
                cuts = [0, *kept, len(v)]
                parts = [v[a:b] for a, b in zip(cuts, cuts[1:])]
                sds = [statistics.stdev(p) for p in parts[-2:] if len(p) > 1 and statistics.stdev(p) > 0]
                gap = abs(statistics.fmean(parts[-1]) - statistics.fmean(parts[-2]))
                if gap > 1.5 * min(sds, default=sd) and gap / abs(m) > 0.05:
                    want = at[kept[-1]]
        assert got.get(name) == want, name


def test_bands_of_short_and_empty_series(spark, shapes):
    s = frame(spark, **shapes)
    assert {"short", "empty"}.isdisjoint(by_id(S.sigma_band(s, 20)))
    iqr = by_id(S.iqr_band(s, 20))
    assert (iqr["short"]["lower"], iqr["empty"]["center"]) == (1.5, 0.0)
    assert by_id(BT.dual_guard_summary(s, 10))["empty"]["total_periods"] == 0
    assert by_id(BT.dual_guard_summary(s, 10))["flat"]["coverage_pct"] == 100.0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(START, float("nan")), (START + dt.timedelta(1), 2.0)], "period date, value double")
    assert S.valid(S.series(df, "value", F.lit("x"))).count() == 1


def test_held_series_are_given_back(spark, shapes):
    s, own = frame(spark, stable=shapes["stable"]), frame(spark, short=shapes["short"]).persist()
    with S.holding():
        assert R.series_profile(s).count() == R.series_profile(own).count() == 1
        assert s.is_cached and s.storageLevel.useMemory
    assert not s.storageLevel.useMemory and own.storageLevel.useMemory
    own.unpersist()
    with pytest.raises(ValueError), S.holding():
        S.held(s)
        raise ValueError
    assert not s.storageLevel.useMemory


def test_calibration_of_a_stable_series(spark, shapes):
    s = frame(spark, stable=shapes["stable"], short=shapes["short"])
    found = by_id(T.calibrate(s, R.series_profile(s)))
    assert found["stable"]["viable"] and found["stable"]["coverage_pct"] >= 70
    assert not found["short"]["viable"] and found["short"]["confidence"] == "LOW"
