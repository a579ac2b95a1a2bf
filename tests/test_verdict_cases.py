"""Hand cases: bounds, missing inputs, ruin, limits, arrival order and replay."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from paxcast.operators import backtest, causal, forecast, metrics, models, pit, risk
from paxcast.sources import fixtures, parsers, snapshots
from paxcast.sources.tables import Tables
from paxcast.streaming import jobs


def test_descendants_of_a_long_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(13)], "src string, dst string")
    got = {r.src: r.n_effects for r in causal.descendants(chain).collect()}
    assert got["n00"] == 13 and got["n12"] == 1
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {r.n_effects for r in causal.descendants(cycle).collect()} == {2}
    paths = {tuple(r.path) for r in causal.simple_paths(cycle).collect()}
    assert ("a", "b", "c") in paths and len(paths) == 6


def test_simple_fit_recovers_the_slope(spark):
    rows = [(float(i), 3.0 * i + (10.0 if i % 2 else 0.0) + (0.1 if i % 3 else -0.1), i % 2) for i in range(200)]
    data = spark.createDataFrame(rows, "x double, y double, g int")
    plain = causal.ols_effect(data, "x", "y").first()
    within = causal.ols_effect(data, "x", "y", "g").first()
    assert abs(within.effect_estimate - 3.0) < 1e-3 and within.n_obs == 200
    assert within.std_err < plain.std_err and within.r_squared > 0.999


def test_short_series_gets_an_error_row(spark):
    rows = [("long", dt.date(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i % 7) for i in range(40)]
    rows += [("short", dt.date(2024, 1, 1) + dt.timedelta(days=i), 5.0) for i in range(10)]
    out = models.exp_smoothing_forecast(spark.createDataFrame(rows, "series string, date date, passengers double")).collect()
    short = [r for r in out if r.series == "short"]
    assert len(short) == 1 and short[0].forecast is None and short[0].error
    assert len([r for r in out if r.series == "long" and r.error is None]) == 7


def test_over_the_limit_opens_nothing(spark):
    sig = spark.createDataFrame([("a", 0.9, 0.5, 1.0), ("a", 0.1, 0.5, 1.0)],
                                "account string, predicted_prob double, market_price double, model_confidence double")
    state = spark.createDataFrame([("a", 99_999_999, 10_000.0, 0.0)], "account string, exposure bigint, capital double, last_pnl double")
    assert [r.position_size for r in risk.position_size(sig, state).collect()] == [0, 0]


def test_missing_model_shares_out_its_weight(spark):
    preds = spark.createDataFrame([("s", 1, "m1", 10.0), ("s", 1, "m2", 20.0), ("s", 1, "m3", 60.0), ("s", 2, "m1", 10.0), ("s", 2, "m2", 20.0)],
                                  "series string, date int, model string, pred double")
    got = {r.date: r.prediction for r in models.ensemble_predict(preds, models.equal_weights(preds)).collect()}
    assert got[1] == pytest.approx(30.0) and got[2] == pytest.approx(15.0)


def test_total_loss_ruins(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, d), r, 1) for d, r in ((1, 0.1), (2, -1.0), (3, 0.1))],
                               "account string, date date, ret double, position bigint")
    r = metrics.trading_metrics(df).first()
    assert r.total_return == -1.0 and r.max_drawdown == -1.0 and r.annual_return == -1.0


def test_unknown_source_type_raises(spark):
    df = spark.createDataFrame([("no such type", dt.datetime(2024, 1, 1))], "data_type string, timestamp timestamp_ntz")
    with pytest.raises(Exception, match="Unknown data type"):
        pit.latest_available_for(df, dt.datetime(2024, 2, 1)).collect()


def test_incomplete_weeks_are_no_history(spark):
    days = [dt.date(2022, 1, 3) + dt.timedelta(days=i) for i in range(7 * 80)]
    gap = days[7 * 70 + 2]
    daily = spark.createDataFrame([("s", d, 50.0) for d in days if d != gap], "series string, date date, passengers double")
    weeks = {r.date for r in forecast.accuracy_history(daily, days=365).collect()}
    assert weeks and all(not (w - dt.timedelta(days=6) <= gap <= w) for w in weeks)


def test_cooldown_sorts_across_arrow_batches(spark):
    folder = tempfile.mkdtemp(prefix="paxcast-orders-")
    orders = fixtures.order_stream(Tables(spark, SF001)).withColumn(
        "side", F.when(F.col("event_id") % 7 == 0, F.lit("maybe")).otherwise(F.lit("yes")))
    orders.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(folder + "/in")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        stream = spark.readStream.schema(orders.schema).parquet(folder + "/in")
        q = (jobs.order_cooldown_stream(stream, 600).writeStream.format("memory").queryName("cooldown_small")
             .outputMode("append").option("checkpointLocation", folder + "/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {(r.event_id, r.accepted, r.message) for r in spark.sql("SELECT * FROM cooldown_small").collect()}
    want = {(r.event_id, r.accepted, r.message) for r in jobs.order_cooldown_batch(orders, 600).collect()}
    assert got == want and len({m for _, _, m in got}) == 3


def _extract(spark, folder, value, mtime):
    schema = "series string, date date, passengers double"
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1), value), (f"B{value}", dt.date(2024, 1, 2), value)], schema)
    df.coalesce(1).write.parquet(folder)
    for name in os.listdir(folder):
        os.utime(os.path.join(folder, name), (mtime, mtime))
    return df.schema


def _stored(spark, target):
    schema = spark.createDataFrame([], "series string, date date, passengers double").schema
    return {(r.series, r.date.day): r.passengers for r in jobs.read_stored(spark, target, schema).collect()}


def test_ingest_orders_by_file_time_and_survives_replay(spark):
    d = tempfile.mkdtemp(prefix="paxcast-ingest-")
    schema = _extract(spark, d + "/src/a", 9.0, 2_000_000_000)  # written last, read in whatever order
    _extract(spark, d + "/src/b", 1.0, 1_000_000_000)
    jobs.incremental_ingest(spark, d + "/src/*", schema, d + "/tgt", d + "/ck1").awaitTermination()
    assert _stored(spark, d + "/tgt")[("A", 1)] == 9.0
    # A new checkpoint on the same target keeps what is stored.
    _extract(spark, d + "/src2/a", 5.0, 2_100_000_000)
    jobs.incremental_ingest(spark, d + "/src2/*", schema, d + "/tgt", d + "/ck2").awaitTermination()
    assert _stored(spark, d + "/tgt") == {("A", 1): 5.0, ("B9.0", 2): 9.0, ("B1.0", 2): 1.0, ("B5.0", 2): 5.0}
    # A replayed batch and a folder that its writer never committed change nothing.
    os.makedirs(d + "/tgt/data/half-0")
    batch = spark.read.parquet(d + "/src2/a").withColumn(jobs.ARRIVAL, F.lit("2020-01-01").cast("timestamp")).withColumn("passengers", F.lit(0.0))
    before = jobs.latest_version(spark, d + "/tgt")
    tag = os.path.basename(before).split("_", 1)[1].rsplit("-", 1)
    jobs.upsert_batch(batch, int(tag[1]), d + "/tgt", run=tag[0])
    assert jobs.latest_version(spark, d + "/tgt") == before and _stored(spark, d + "/tgt")[("A", 1)] == 5.0


def test_cells_with_markup_and_references(spark):
    page = ("<table><tr><th>Date</th></tr><tr><td><i>1/3/2024&nbsp;</i></td><td><b>2,345,678</b></td></tr>"
            "<tr><td>1/4/2024</td><td> <span>1&#44;000</span>&#160;</td></tr><tr><td>total</td><td>5</td></tr></table>")
    df = spark.createDataFrame([("s", page)], "series string, html string")
    got = [(r.date, r.passengers) for r in parsers.parse_count_pages(df).orderBy("date").collect()]
    assert got == [(dt.date(2024, 1, 3), 2345678.0), (dt.date(2024, 1, 4), 1000.0)]


def test_snapshots_latest_read_is_pruned(spark):
    path = tempfile.mkdtemp(prefix="paxcast-snap-") + "/t"
    for stamp, value in (("20240101_000000", 1), ("20240301_000000", 3), ("20240201_000000", 2)):
        snapshots.write_snapshot(spark.createDataFrame([(value,)], "v int"), path, stamp)
    latest = snapshots.read_latest(spark, path)
    assert [r.v for r in latest.collect()] == [3]
    assert all("20240301" in f for f in latest.inputFiles()) or "PartitionFilters: [isnotnull" in latest._jdf.queryExecution().toString()


def test_models_are_saved_and_the_newest_is_loaded(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    root = tempfile.mkdtemp(prefix="paxcast-models-")
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    for cols in (["a"], ["a", "b"]):
        models.save_model(Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="f")]).fit(df), root, "m")
    assert models.load_latest_model(spark, root, "m").stages[0].getInputCols() == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        models.load_latest_model(spark, root, "none")


def test_general_control_set_agrees_with_the_closed_form(spark):
    rows = [(float(i % 17), 2.0 * (i % 17) + 5.0 * (i % 3) + 0.01 * (i % 5), "abc"[i % 3]) for i in range(300)]
    data = spark.createDataFrame(rows, "x double, y double, g string")
    one, other = causal.ols_effect(data, "x", "y", "g").first(), causal.ols_effect_ml(data, "x", "y", categorical=["g"]).first()
    assert one.effect_estimate == pytest.approx(other.effect_estimate, rel=1e-6)
    assert one.std_err == pytest.approx(other.std_err, rel=1e-4) and one.n_obs == other.n_obs


def test_running_pnl_stream_flags_a_breach(spark):
    d = tempfile.mkdtemp(prefix="paxcast-pnl-")
    rows = [("a", dt.datetime(2024, 1, 1, 9), "yes", 10, -60.0), ("a", dt.datetime(2024, 1, 1, 15), "no", 5, -50.0), ("b", dt.datetime(2024, 1, 1, 9), "yes", 1, 5.0)]
    trades = spark.createDataFrame(rows, "account string, ts timestamp, side string, size bigint, pnl double")
    trades.coalesce(1).write.parquet(d + "/in")
    limits = spark.createDataFrame([("a", 100.0), ("b", 100.0)], "account string, daily_loss_limit double")
    stream = spark.readStream.schema(trades.schema).parquet(d + "/in")
    q = (jobs.running_daily_pnl(stream, limits).writeStream.format("memory").queryName("pnl_out").outputMode("update")
         .option("checkpointLocation", d + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.account: (r.daily_pnl, r.gross_exposure, r.limit_breached) for r in spark.sql("SELECT * FROM pnl_out").collect()}
    assert got == {"a": (-110.0, 15, True), "b": (5.0, 1, False)}


def test_win_rate_counts_positive_realised_pnl(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 7)]
    rows = [("a", d, t, p) for d, t, p in zip(days, (10, 10, 4, 4, -3, 0), (0.5, 0.6, 0.7, 0.2, 0.4, 0.5))]
    led = backtest.daily_ledger(spark.createDataFrame(rows, "account string, date date, target bigint, price double"))
    got = [r.realised_pnl for r in led.orderBy("date").collect()]
    # buy 10 at 0.5; hold; sell 6 at 0.7; hold; sell 7 at 0.4 (closes 4, opens -3); buy 3 at 0.5
    want = [None, None, 6 * 0.2, None, 4 * -0.1, 3 * -0.1]
    assert [w is None for w in want] == [g is None for g in got]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None])
    assert backtest.ledger_metrics(led).first().win_rate == pytest.approx(1 / 3)


def test_end_bounds_the_monday(spark):
    days = [dt.date(2022, 1, 3) + dt.timedelta(days=i) for i in range(7 * 70)]
    daily = spark.createDataFrame([("s", d, 50.0 + d.day) for d in days], "series string, date date, passengers double")
    last = days[-7]  # the Monday of the last week
    weeks = {r.monday for r in backtest.eligible_weeks(daily, end=str(last + dt.timedelta(days=2))).collect()}
    assert last in weeks
    assert weeks <= {r.monday for r in backtest.mondays(spark, "2022-01-03", str(last)).collect()}
    assert last not in {r.monday for r in backtest.eligible_weeks(daily, end=str(last - dt.timedelta(days=1))).collect()}
