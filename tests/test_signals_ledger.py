"""Feature checks, closing rules and average cost by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paxcast.operators import backtest, features, signals


def test_required_features_are_checked_before_any_job(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert features.missing_features(df, ["b", "z", "c"]) == ["c", "z"]
    assert features.validate_features(df, ["a", "b"]) is df
    with pytest.raises(ValueError, match="z"):
        features.validate_features(df, ["a", "z"])


def test_only_missing_important_features_cost_confidence(spark):
    importance = spark.createDataFrame([("a", 1.0), ("b", 0.9), ("c", 0.1), ("d", 0.05), ("e", 0.01), ("gone", 0.95)], "feature string, importance double")
    # The 80th percentile of the six is 0.95: only what lies above it counts.
    current = spark.createDataFrame([("s", 1, 1.0, None, None, 1.0, 1.0), ("s", 2, None, 1.0, 1.0, 1.0, 1.0)],
                                    "series string, date int, a double, b double, c double, d double, e double")
    got = {r.date: (r.missing_features, r.feature_confidence) for r in signals.feature_reliability(current, importance).collect()}
    assert got == {1: (0, 1.0), 2: (1, pytest.approx(0.8))}
    half = {r.date: r.missing_features for r in signals.feature_reliability(current, importance, quantile=0.5).collect()}
    assert half == {1: 2, 2: 2}  # a, b and the absent column


def test_confidence_never_exceeds_one_whatever_models_are_present(spark):
    preds = spark.createDataFrame([("s", d, f"m{m}", 100.0, 100.0) for d in range(3) for m in range(6)], "series string, date int, model string, pred double, actual double")
    out = signals.model_confidence(preds).collect()
    assert all(r.feature_confidence == 1.0 and r.confidence <= 1.0 for r in out)
    rel = spark.createDataFrame([("s", 1, 2, 0.64)], "series string, date int, missing_features bigint, feature_confidence double")
    got = {r.date: r.feature_confidence for r in signals.model_confidence(preds, reliability=rel).collect()}
    assert got == {0: 1.0, 1: 0.64, 2: 1.0}


def test_losses_close_positions_in_order(spark):
    day = dt.date(2024, 3, 4)
    rows = [("a", i, day, 0.7, 0.4, 0.9, 5, 1000.0, d, p) for i, (d, p) in enumerate([(0.0, 0.0), (-0.2, 0.0), (0.0, -0.2), (-0.2, -0.2)])]
    df = spark.createDataFrame(rows, "account string, ts int, signal_date date, predicted_probability double, price double, confidence double, "
                                     "days_to_expiry int, volume double, daily_pnl_pct double, position_pnl_pct double")
    got = {r.ts: (r.action, r.size > 0, r.reason) for r in signals.strategy_signals(df).collect()}
    assert got[0][0] == "buy" and got[0][1]
    assert got[1] == ("close", False, "Daily loss limit hit") == got[3]
    assert got[2] == ("close", False, "Position loss limit hit")


def test_average_cost_matches_a_walk(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for account in ("a", "b"):
        held, cost, target = 0, 0.0, 0
        for i in range(400):
            target = rng.choice([target, target + rng.randint(-9, 9), 0, -target, None])
            price = rng.randint(1, 99) / 100
            rows.append((account, dt.date(2020, 1, 1) + dt.timedelta(days=i), target, price))
            target = held if target is None else target
            size, gain = target - held, None
            if size and held * size >= 0:
                cost = (cost * abs(held) + price * abs(size)) / (abs(held) + abs(size))
            elif size:
                gain = min(abs(size), abs(held)) * (price - cost) * (1 if held > 0 else -1)
                cost = price if abs(size) > abs(held) else cost
            held += size
            want[account, i] = gain
    led = backtest.daily_ledger(spark.createDataFrame(rows, "account string, date date, target bigint, price double"))
    assert "Pandas" not in led._jdf.queryExecution().toString() and "Python" not in led._jdf.queryExecution().toString()
    got = {(r.account, (r.date - dt.date(2020, 1, 1)).days): r.realised_pnl for r in led.collect()}
    assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items() if v is not None)


def test_fares_in_one_pass_equal_the_processed_ones(spark):
    from paxcast.operators import aggregates, clean

    rng = random.Random(3)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i % 9)
    rows = [(f"r{i % 4}", day(rng.randint(0, 50)), rng.choice([None, rng.uniform(50, 90)]), rng.choice([None, float(rng.randint(0, 200))])) for i in range(400)]
    rows += [("flat", day(i), 10.1, 0.0) for i in range(9)] + [("one", day(2), 7.0, 3.0)]
    df = spark.createDataFrame(rows, "route string, date date, price double, capacity double")
    want = {r.date: tuple(r)[1:] for r in aggregates.airline_features(clean.process_fares(df)).collect()}
    got = {r.date: tuple(r)[1:] for r in aggregates.fare_features(df).collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert got[d] == pytest.approx(want[d], rel=1e-9, nan_ok=True)


def test_calendar_columns_equal_the_dimension(spark):
    from paxcast.operators import calendar

    df = spark.createDataFrame([(dt.date(2018, 12, 20) + dt.timedelta(days=i),) for i in range(0, 1500)], "date date")
    want = {r.date: tuple(r) for r in calendar.calendar_dim(df).collect()}
    assert {r.date: tuple(r) for r in calendar.with_calendar(df).collect()} == want
