"""Stream = batch: the streaming jobs under availableNow match their batch forms."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from paxcast.sources import fixtures
from paxcast.sources.tables import Tables
from paxcast.streaming import jobs


def _orders(spark):
    t = Tables(spark, SF001)
    return fixtures.order_stream(t).withColumn(
        "side", F.when(F.col("event_id") % 2 == 0, F.lit("yes")).otherwise(F.lit("no")))


def test_cooldown_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="paxcast-orders-")
    orders = _orders(spark)
    orders.write.mode("overwrite").parquet(d + "/in")
    stream = spark.readStream.schema(orders.schema).parquet(d + "/in")
    q = (jobs.order_cooldown_stream(stream, 600).writeStream.format("memory").queryName("cooldown_out")
         .outputMode("append").option("checkpointLocation", d + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.event_id, r.accepted) for r in spark.sql("SELECT * FROM cooldown_out").collect()}
    want = {(r.event_id, r.accepted) for r in jobs.order_cooldown_batch(orders, 600).collect()}
    assert got == want and any(not a for _, a in got)


def test_incremental_ingest_last_wins(spark):
    d = tempfile.mkdtemp(prefix="paxcast-ingest-")
    schema = "series string, date date, passengers double"
    first = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 1, 2), 2.0)], schema)
    first.write.parquet(d + "/src/part1")
    q = jobs.incremental_ingest(spark, d + "/src/*", first.schema, d + "/tgt", d + "/ck")
    q.awaitTermination()
    fix = spark.createDataFrame([("A", dt.date(2024, 1, 2), 20.0)], schema)
    fix.write.parquet(d + "/src/part2")
    q = jobs.incremental_ingest(spark, d + "/src/*", first.schema, d + "/tgt", d + "/ck")
    q.awaitTermination()
    out = {r.date.day: r.passengers for r in jobs.read_stored(spark, d + "/tgt", first.schema).collect()}
    assert out == {1: 1.0, 2: 20.0}


def test_weather_windows_match_batch(spark):
    d = tempfile.mkdtemp(prefix="paxcast-weather-")
    t = Tables(spark, SF001)
    obs = t.events.select(F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")).alias("airport"),
                          F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("temperature"),
                          F.col("value").alias("wind_speed"), (F.col("value") / 100).alias("precipitation"))
    obs.write.parquet(d + "/in")
    stream = spark.readStream.schema(obs.schema).parquet(d + "/in")
    q = (jobs.daily_weather_windows(stream).writeStream.format("memory").queryName("wx_out").outputMode("append")
         .option("checkpointLocation", d + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.airport, r.window_start, r.observations) for r in spark.sql("SELECT * FROM wx_out").collect()}
    batch = obs.groupBy("airport", F.window("timestamp", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    want = {(r.airport, r.w.start, r.n) for r in batch.collect()}
    # The last open window is not emitted in append mode; everything emitted matches the batch.
    assert got and got <= want


def _months(spark, root):
    return dict(jobs.stored_files(spark, root))


def _batch(spark, rows, at=1):
    df = spark.createDataFrame(rows, "series string, date date, passengers double")
    return df.withColumn(jobs.ARRIVAL, F.timestamp_seconds(F.lit(at)))


def test_untouched_partitions_keep_their_files(spark):
    root = tempfile.mkdtemp(prefix="paxcast-upsert-")
    jobs.upsert_batch(_batch(spark, [("A", dt.date(2024, m, d), float(m)) for m in (1, 2, 3) for d in (1, 2)] + [("N", None, 7.0)]), 0, root)
    before = _months(spark, root)
    assert len(before) == 4
    jobs.upsert_batch(_batch(spark, [("A", dt.date(2024, 2, 2), 20.0), ("B", dt.date(2024, 4, 1), 4.0)]), 1, root)
    after = _months(spark, root)
    assert {k: after[k] for k in before if k != "2024-02-01"} == {k: before[k] for k in before if k != "2024-02-01"}
    assert after["2024-02-01"] != before["2024-02-01"] and "2024-04-01" in after
    schema = _batch(spark, []).drop(jobs.ARRIVAL).schema
    rows = {(r.series, r.date): r.passengers for r in jobs.read_stored(spark, root, schema).collect()}
    assert rows[("A", dt.date(2024, 2, 2))] == 20.0 and rows[("A", dt.date(2024, 2, 1))] == 2.0 and rows[("N", None)] == 7.0 and len(rows) == 8


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="paxcast-crash-")
    schema = _batch(spark, []).drop(jobs.ARRIVAL).schema
    jobs.upsert_batch(_batch(spark, [("A", dt.date(2024, 1, 1), 1.0)]), 0, root)
    version = jobs.latest_version(spark, root)

    def crash(*args):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(jobs, "_commit", crash)
        try:
            jobs.upsert_batch(_batch(spark, [("A", dt.date(2024, 1, 1), 2.0)]), 1, root)
        except OSError:
            pass
    assert jobs.latest_version(spark, root) == version
    assert [r.passengers for r in jobs.read_stored(spark, root, schema).collect()] == [1.0]
    jobs.upsert_batch(_batch(spark, [("A", dt.date(2024, 1, 1), 2.0)]), 1, root)  # the retry
    jobs.upsert_batch(_batch(spark, [("A", dt.date(2024, 1, 1), 9.0)]), 1, root)  # a replay
    assert [r.passengers for r in jobs.read_stored(spark, root, schema).collect()] == [2.0]


def test_old_versions_are_forgotten_with_their_files(spark):
    root = tempfile.mkdtemp(prefix="paxcast-forget-")
    schema = _batch(spark, []).drop(jobs.ARRIVAL).schema
    for i in range(5):
        jobs.upsert_batch(_batch(spark, [("A", dt.date(2024, 1, 1), float(i)), *([("A", dt.date(2023, 1, 1), 0.5)] if not i else [])]), i, root, keep=2)
    assert len(jobs._manifests(spark, root)) == 2
    assert {r.passengers for r in jobs.read_stored(spark, root, schema).collect()} == {4.0, 0.5}
    older = [f for _, f in jobs.stored_files(spark, root, jobs._manifests(spark, root)[0])]
    assert {r.passengers for r in spark.read.schema(schema).parquet(*(f"{root}/{f}" for f in older)).collect()} == {3.0, 0.5}


def _run(spark, stream, name, folder):
    q = (stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/ck-{name}")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


WEATHER = "airport string, timestamp timestamp, temperature double, wind_speed double, precipitation double"


def _hours(spark, folder, batches):
    """One file per batch of (hour, value), read one per trigger in this order."""
    import os
    for i, hours in enumerate(batches):
        rows = [("A1", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), v, 2 * v, 1.0) for h, v in hours]
        spark.createDataFrame(rows, WEATHER).coalesce(1).write.parquet(f"{folder}/in/{i}")
        for f in os.listdir(f"{folder}/in/{i}"):
            os.utime(f"{folder}/in/{i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(WEATHER).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_sliding_windows_and_a_late_row(spark):
    """Six-hour windows every two hours; the last batch's row for hour 1 comes after the
    watermark has closed the windows that end by hour 6."""
    d = tempfile.mkdtemp(prefix="paxcast-slide-")
    on_time = [(h, float(h)) for h in range(12)]
    stream = _hours(spark, d, [on_time, [(20, 20.0)], [(1, 1000.0), (26, 26.0)], [(60, 60.0)]])
    q = _run(spark, jobs.daily_weather_windows(stream, watermark="2 hours", window="6 hours", slide="2 hours"), "slide_out", d)
    zero = dt.datetime(2024, 1, 1)
    got = {int((r.window_start - zero).total_seconds() // 3600): (r.avg_temperature, r.max_wind_speed, r.total_precipitation, r.observations)
           for r in spark.sql("SELECT * FROM slide_out").collect()}
    seen = dict(on_time) | {20: 20.0, 26: 26.0}  # the late row is in none of them
    want = {}
    for start in range(-4, 30, 2):
        inside = [v for h, v in seen.items() if start <= h < start + 6]
        if inside:
            want[start] = (sum(inside) / len(inside), 2 * max(inside), float(len(inside)), len(inside))
    assert got == want
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    assert dropped > 0


def test_weather_window_values_match_batch(spark):
    d = tempfile.mkdtemp(prefix="paxcast-wxval-")
    stream = _hours(spark, d, [[(h, float(h % 7)) for h in range(72)], [(200, 1.0)]])
    _run(spark, jobs.daily_weather_windows(stream), "wx_values", d)
    batch = spark.read.schema(WEATHER).parquet(f"{d}/in/*").groupBy("airport", F.window("timestamp", "1 day").alias("w")).agg(
        F.avg("temperature"), F.max("wind_speed"), F.sum("precipitation"), F.count("*"))
    want = {(r.airport, r.w.start, *tuple(r)[2:]) for r in batch.collect() if r.w.start < dt.datetime(2024, 1, 5)}
    got = {(r.airport, r.window_start, r.avg_temperature, r.max_wind_speed, r.total_precipitation, r.observations)
           for r in spark.sql("SELECT * FROM wx_values").collect()}
    assert got == want and len(got) == 3
