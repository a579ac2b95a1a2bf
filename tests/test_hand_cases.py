"""Hand-computed edge cases (FIXTURES.md part C)."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from paxcast.functions.stats import full_frame
from paxcast.operators import backtest, calendar, metrics, risk, signals
from paxcast.sources import parsers


def test_rolling_mean_null_until_full(spark):
    df = spark.createDataFrame([("s", dt.date(2024, 1, d), float(d)) for d in range(1, 8)], "series string, date date, v double")
    w = Window.partitionBy("series").orderBy("date")
    out = [r.m for r in df.select(full_frame(F.avg, "v", w, -6, 0).alias("m")).orderBy("date").collect()]
    assert out[5] is None and out[6] == 4.0


def test_ticker_thresholds(spark):
    df = spark.createDataFrame([("KXTSAW-26JAN18-A2.80",), ("KXTSAW-26JAN18-B2.15",), ("KXTSAW-26JAN18-T17500000",),
                                ("KXTSAW-26JAN18",)], "t string")
    got = [r.x for r in df.select(parsers.ticker_threshold(F.col("t")).alias("x")).collect()]
    assert got == [2_800_000, 2_150_000, 17_500_000, 0]


def test_event_date(spark):
    df = spark.createDataFrame([("KXTSAW-26JAN18",)], "t string")
    assert df.select(parsers.event_date(F.col("t")).alias("d")).first().d == dt.date(2026, 1, 18)


def test_limit_aware_size(spark):
    sig = spark.createDataFrame([("a", 0.65, 0.60, 0.8), ("a", 0.65, 0.61, 0.8)],
                                "account string, predicted_prob double, market_price double, model_confidence double")
    state = spark.createDataFrame([("a", 80, 10_000.0, 0.0)], "account string, exposure bigint, capital double, last_pnl double")
    got = [r.position_size for r in risk.position_size(sig, state).collect()]
    assert got == [800, 0]


def test_market_adjustment(spark):
    df = spark.range(1).select(risk.market_adjusted_size(F.lit(1000), F.lit(0.2), F.lit(0.8), F.lit(0.1)).alias("s"))
    assert df.first().s == 633


def test_kelly(spark):
    df = spark.createDataFrame([(0.65, 0.5), (0.60, 0.5)], "p double, price double")
    got = [r.n for r in df.select(signals.kelly_contracts(F.lit(1000.0), F.col("p"), F.col("price")).alias("n")).collect()]
    assert got == [100, 99]


def test_half_even_accuracy(spark):
    df = spark.createDataFrame([(0.5, 0, 0.4)], "prob double, outcome bigint, price double")
    assert metrics.contract_metrics(df).first().prediction_accuracy == 1.0


def test_contract_choice_ties(spark):
    # Thresholds far below the forecast: P(above) is exactly 1 for both, so
    # equal prices give equal EVs. The earlier contract wins.
    rows = [("e", dt.date(2024, 1, 7), 0, 10, 1_000_000.0, 1.0, 0.6, 0.4),
            ("e", dt.date(2024, 1, 7), 1, 20, 1_000_000.0, 1.0, 0.6, 0.4)]
    schema = ("series string, week_end date, rung int, threshold bigint, prediction double, uncertainty double, "
              "yes_price double, no_price double")
    r = signals.select_contract(spark.createDataFrame(rows, schema), min_ev=0.0, high_confidence=1.1).first()
    assert r.contract_threshold == 10 and r.side == "yes"
    # YES before NO at an equal EV on one contract (ev_yes = 1 - 0.6, ev_no = 0 - (-0.4)).
    one = [("e", dt.date(2024, 1, 7), 0, 10, 1_000_000.0, 1.0, 0.6, -0.4)]
    r = signals.select_contract(spark.createDataFrame(one, schema), min_ev=0.0, high_confidence=1.1).first()
    assert r.side == "yes"


def test_settlement_at_threshold(spark):
    df = spark.createDataFrame([(100.0, 100, "yes"), (100.0, 100, "no")], "actual double, contract_threshold bigint, side string")
    got = [r.profit for r in backtest.settle(df).collect()]
    assert got == [-100.0, 100.0]


def test_empty_summary(spark):
    keys = spark.createDataFrame([("s",)], "series string")
    empty = spark.createDataFrame([], "series string, week_end date, profit double, equity double, drawdown double")
    r = backtest.summary(empty, keys).first()
    assert r.num_weeks == 0 and r.total_profit == 0.0 and r.final_equity == backtest.INITIAL_CAPITAL


def test_position_changes_count_first_row(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, d), 0.01, p) for d, p in [(1, 1), (2, 1), (3, 2)]],
                               "account string, date date, ret double, position bigint")
    assert metrics.trading_metrics(df).first().position_changes == 2


def test_seasons(spark):
    df = spark.createDataFrame([(dt.date(2024, 4, 10),), (dt.date(2024, 7, 10),), (dt.date(2024, 12, 10),)], "date date")
    rows = {r.date.month: r for r in calendar.calendar_dim(df).collect()}
    assert rows[4].is_shoulder_season == 1 and rows[7].is_summer == 1 and rows[12].is_winter == 1


def test_holidays_and_next_holiday(spark):
    df = spark.createDataFrame([(dt.date(2024, 7, 3),), (dt.date(2024, 7, 4),), (dt.date(2024, 11, 28),)], "date date")
    rows = {r.date: r for r in calendar.calendar_dim(df).collect()}
    assert rows[dt.date(2024, 7, 4)].is_holiday == 1
    assert rows[dt.date(2024, 7, 3)].days_to_holiday == 1
    assert rows[dt.date(2024, 11, 28)].is_holiday == 1  # fourth Thursday of November


def test_normal_cdf_symmetry(spark):
    from paxcast.functions.stats import norm_cdf

    df = spark.createDataFrame([(1.3, -1.3)], "a double, b double")
    r = df.select(norm_cdf("a").alias("pa"), norm_cdf("b").alias("pb")).first()
    assert abs(r.pa + r.pb - 1.0) < 1e-12 and abs(r.pa - 0.9031995154) < 1e-7
