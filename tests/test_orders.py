"""Order validation against a sequential walk, and its jump functions."""

import datetime as dt
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from paxcast.streaming import jobs

SCHEMA = "account string, event_id bigint, ts timestamp, size bigint, price double, side string"
ZERO = dt.datetime(2024, 1, 1)


def sequential(rows, cooldown, limited=lambda r: None):
    """(event_id -> (accepted, message)) by walking every account's orders in time."""
    out, last = {}, {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        account, event, ts, size, price, side = r
        fault = ("Size must be positive" if size <= 0 else "Size exceeds maximum (1000 contracts)" if size > 1000
                 else "Price must be between 0 and 1" if not 0 < price < 1 else "Side must be 'yes' or 'no'" if side.lower() not in ("yes", "no") else None)
        if fault:
            out[event] = (False, fault)
        elif account in last and (ts - last[account]).total_seconds() < cooldown:
            out[event] = (False, "cooldown")
        elif limited(r):
            out[event] = (False, "Risk limit: " + limited(r))
        else:
            last[account], out[event] = ts, (True, "Order validated")
    return out


def orders(seed, n, accounts, mean_gap):
    rng = random.Random(seed)
    at, rows = {a: 0.0 for a in accounts}, []
    for i in range(n):
        a = rng.choice(accounts)
        at[a] += rng.choice([0, 0.000001, rng.expovariate(1 / mean_gap), mean_gap])
        rows.append((a, i, ZERO + dt.timedelta(seconds=at[a]), rng.choice([1, 50, 1000, 0, 1001] if rng.random() < 0.2 else [5]), rng.choice([0.4, 0.9]), rng.choice(["yes", "NO"])))
    return rows


def got(df):
    return {r.event_id: (r.accepted, r.message) for r in df.collect()}


@pytest.mark.parametrize("cooldown,gap", [(5, 0.4), (60, 30), (0.5, 3)])
def test_batch_equals_the_sequential_walk(spark, cooldown, gap, monkeypatch):
    monkeypatch.setattr(jobs, "SLOT_COOLDOWNS", 16)
    rows = orders(int(gap * 10), 3000, ["a", "b", None], gap)
    assert got(jobs.order_cooldown_batch(spark.createDataFrame(rows, SCHEMA), cooldown)) == sequential(rows, cooldown)


def test_limits_start_no_cooldown_wherever_a_slot_begins(spark, monkeypatch):
    monkeypatch.setattr(jobs, "SLOT_COOLDOWNS", 7)
    rows = orders(3, 2000, ["a"], 2.0)
    rows = [(a, e, t, s, p if (t - ZERO).total_seconds() % 400 < 200 else 0.999, d) for a, e, t, s, p, d in rows]
    state = spark.createDataFrame([("a", 0, 10.0, 0.0)], "account string, exposure bigint, capital double, last_pnl double")
    out = got(jobs.order_cooldown_batch(spark.createDataFrame(rows, SCHEMA), 5, state))

    def limited(r):  # exposure 0: leverage and concentration by the order alone
        value = r[3] * r[4]
        return "Leverage limit exceeded" if value > 10.0 * jobs.risk.MAX_LEVERAGE else "Concentration limit exceeded" if value > 10.0 * jobs.risk.CONCENTRATION_LIMIT else None

    assert out == sequential(rows, 5, limited)
    assert {m for _, m in out.values()} >= {"cooldown", "Order validated"} and any("limit" in m for _, m in out.values())


def test_an_account_without_a_gap_is_spread_over_groups(spark, monkeypatch):
    """No gap anywhere reaches the cooldown, yet every slot is a group of its own."""
    monkeypatch.setattr(jobs, "SLOT_COOLDOWNS", 2)
    rng = random.Random(1)
    at, rows = 0.0, []
    for i in range(2500):
        at += rng.uniform(0.05, 4.9)
        rows.append(("a", i, ZERO + dt.timedelta(seconds=at), 5, 0.5, "yes"))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(jobs.order_cooldown_batch(df, 5)) == sequential(rows, 5)
    able = df.select("account", F.unix_micros("ts").alias("_us")).withColumn("_slot", F.floor(F.col("_us") / 10_000_000))
    enters = jobs.slot_thresholds(able, 5_000_000)
    assert enters.count() > 500 and enters.where(F.col("_enter") == jobs.FREE).count() == 1


def test_jumps_compose_like_the_walk():
    rng = random.Random(2)
    for _ in range(300):
        cooldown = rng.randint(1, 30)
        times = sorted(rng.sample(range(200), rng.randint(0, 25)))
        cut = rng.randint(0, 200)

        def walk(t, chosen):
            for u in chosen:
                if u >= t:
                    t = u + cooldown
            return t

        first = jobs.Jumps.of_times([u for u in times if u < cut], cooldown)
        second = jobs.Jumps.of_times([u for u in times if u >= cut], cooldown)
        starts = np.arange(-5, 240)
        want = [walk(t, times) for t in starts]
        assert first.then(second)(starts).tolist() == want
        assert jobs.Jumps.of_times(times, cooldown)(starts).tolist() == want


def test_empty_orders(spark):
    assert jobs.order_cooldown_batch(spark.createDataFrame([], SCHEMA), 5).count() == 0


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def stream_of(spark, batches):
    """One file per batch, read one per trigger in this order."""
    d = tempfile.mkdtemp(prefix="paxcast-validate-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{d}/in/{i}")
        for f in os.listdir(f"{d}/in/{i}"):
            os.utime(f"{d}/in/{i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return d, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{d}/in/*")


def answers(spark, name, folder, stream, **options):
    q = (jobs.order_validation_stream(stream, **options).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", folder + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return q, {r.event_id: (r.accepted, r.message) for r in spark.sql(f"SELECT * FROM {name}").collect()}


def test_stream_with_limits_equals_the_batch_on_shuffled_orders(spark, rocksdb):
    rows = orders(5, 600, ["a", "b"], 3.0)
    state = spark.createDataFrame([("a", 0, 400.0, 0.0), ("b", 0, 1e9, 0.0)], "account string, exposure bigint, capital double, last_pnl double")
    want = got(jobs.order_cooldown_batch(spark.createDataFrame(rows, SCHEMA), 5, state))
    assert any("limit" in m for _, m in want.values())
    random.Random(9).shuffle(rows)
    end = [("end", 10_000, ZERO + dt.timedelta(days=30), 5, 0.5, "yes")]
    folder, stream = stream_of(spark, [rows[:200], rows[200:400], rows[400:], end])
    q, out = answers(spark, "validated", folder, stream, cooldown_seconds=5, state=state, lateness="1 day")
    assert {e: a for e, a in out.items() if e != 10_000} == want
    # Answered accounts leave nothing behind; what is kept belongs to the last order.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def test_a_late_order_is_dropped_and_changes_no_answer(spark, rocksdb):
    at = lambda s: ZERO + dt.timedelta(seconds=s)
    first = [("a", i, at(10 * i), 5, 0.5, "yes") for i in range(10)]
    folder, stream = stream_of(spark, [first, [("a", 50, at(1000), 5, 0.5, "yes")], [("a", 99, at(5), 5, 0.5, "yes"), ("a", 51, at(1200), 5, 0.5, "yes")],
                                       [("a", 52, at(9000), 5, 0.5, "yes")]])
    q, out = answers(spark, "late_orders", folder, stream, cooldown_seconds=15, lateness="60 seconds")
    assert 99 not in out
    want = sequential(first + [("a", 50, at(1000), 5, 0.5, "yes"), ("a", 51, at(1200), 5, 0.5, "yes")], 15)
    assert {e: a for e, a in out.items() if e != 52} == want
    assert sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]) == 1
