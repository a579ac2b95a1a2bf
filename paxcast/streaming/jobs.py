"""Structured Streaming jobs (T1-T4) and the batch form of order validation (M6).

* T1 incremental ingest: file-source stream, ``foreachBatch`` upsert by
  (key, date), the last extract winning; a batch rewrites the partitions it
  touches and commits them with a manifest.
* T2 hourly observations -> per-airport daily or sliding windows with a watermark.
* T3 order cooldown in order of arrival: keyed state (last accepted time per
  account) in ``applyInPandasWithState``; full validation in order of time,
  however orders arrive: buffered state and timers in ``transformWithState``.
* T4 running daily P&L per account: windowed sums in update mode joined to
  a static limits table.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from paxcast.operators import risk

#: Column in which a micro-batch carries when its file was last written.
ARRIVAL = "_arrival"

# Order limits.
MAX_CONTRACTS_PER_TRADE = 1000
TRADE_COOLDOWN_SECONDS = 5

#: Cooldowns that a time slot of an account spans.
SLOT_COOLDOWNS = 1024


# --- T1 ---------------------------------------------------------------------------
#
# A stored table is a set of Parquet files, at most a few per partition, and a series of
# manifests ``manifest/<n>_<batch>`` that list them. Files are never changed; a batch
# writes new files for the partitions it touches and then, as its last act, a manifest
# naming these and the untouched ones. The newest manifest is the table, so a crash
# at any point leaves the version before it.

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed manifests, oldest first."""
    fs, p = _fs(spark, f"{root}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((n for n in names if n[0].isdigit()), key=_number)


def _number(manifest: str) -> int:
    return int(manifest.split("_", 1)[0])


def latest_version(spark: SparkSession, root: str) -> str | None:
    """Name of the newest committed manifest (None when there is none)."""
    names = _manifests(spark, root)
    return names[-1] if names else None


def stored_files(spark: SparkSession, root: str, manifest: str | None = None) -> list[tuple[str, str]]:
    """(partition, file) of the table's newest version, or of a named one."""
    names = _manifests(spark, root)
    if not names:
        return []
    fs, p = _fs(spark, f"{root}/manifest/{manifest or names[-1]}")
    stream = fs.open(p)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return [tuple(line.split("\t")) for line in text.splitlines()]


def read_stored(spark: SparkSession, root: str, schema: T.StructType, partitions: set[str] | None = None) -> DataFrame:
    """The stored table, or some of its partitions; without rows if nothing is stored."""
    files = [f"{root}/{f}" for p, f in stored_files(spark, root) if partitions is None or p in partitions]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, root: str, name: str, files: list[tuple[str, str]]) -> None:
    """Write a manifest beside its place and rename it there: readers see all or nothing."""
    fs, place = _fs(spark, f"{root}/manifest/{name}")
    _, draft = _fs(spark, f"{root}/manifest/.{name}.{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray("".join(f"{p}\t{f}\n" for p, f in sorted(files)).encode()))
    finally:
        out.close()
    if not fs.rename(draft, place):
        raise RuntimeError(f"manifest {name} is there already")


def upsert_batch(batch: DataFrame, batch_id: int, target: str, keys=("series", "date"), run: str = "run",
                 partition: str = "date", unit: str = "month", keep: int | None = 20) -> None:
    """T1 step: merge one micro-batch into the stored table, last value wins.

    The table is partitioned by the ``unit`` (month, year, day) of ``partition``. Only the
    partitions that occur in the batch are read, merged and written anew; the files
    of the others stay as they are and are named again. Stored rows come
    first, then the batch in the order of its ``arrival`` column (the time its file was
    last written), and ``max_by`` keeps the newest row per key (partial aggregation).
    A replayed batch whose manifest is there changes nothing; batches are numbered after
    the newest manifest, so a new checkpoint on an existing target loses nothing.
    Of older versions the newest ``keep`` stay readable (None: all); files that no kept
    manifest names are removed after the commit.
    """
    spark = batch.sparkSession
    names = _manifests(spark, target)
    tag = f"{run}-{batch_id}"
    if any(n.split("_", 1)[1] == tag for n in names):
        return  # replayed after its version was committed
    cols = [c for c in batch.columns if c != ARRIVAL]
    schema = batch.select(*cols).schema
    part = F.coalesce(F.date_format(F.date_trunc(unit, F.col(partition)), "yyyy-MM-dd"), F.lit("none"))
    touched = {r[0] for r in batch.select(part).distinct().collect()}  # at most the table's partitions
    if not touched:
        return _commit(spark, target, f"{_number(names[-1]) + 1 if names else 0}_{tag}", stored_files(spark, target))
    # Rows of one file stand in the order of its rows; files by their time.
    never = F.struct(F.lit(None).cast("timestamp"), F.lit(None).cast("bigint"))
    new = batch.withColumn("_seq", F.struct(F.col(ARRIVAL).cast("timestamp"), F.monotonically_increasing_id()))
    old = read_stored(spark, target, schema, touched).withColumn("_seq", never)
    others = [c for c in cols if c not in keys]
    merged = old.unionByName(new.select(*cols, "_seq")).groupBy(*keys).agg(F.max_by(F.struct(*others), "_seq").alias("_v")) \
        .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others]).withColumn("_part", part)
    folder = f"data/{tag}-{uuid.uuid4().hex}"
    merged.select(*cols, "_part").repartition("_part").write.partitionBy("_part").parquet(f"{target}/{folder}")
    written = []
    fs, p = _fs(spark, f"{target}/{folder}")
    for d in fs.listStatus(p):
        name = d.getPath().getName()
        if name.startswith("_part="):
            value = name[len("_part="):]
            written += [(value, f"{folder}/{name}/{f.getPath().getName()}") for f in fs.listStatus(d.getPath()) if f.getPath().getName().endswith(".parquet")]
    untouched = [(v, f) for v, f in stored_files(spark, target) if v not in touched]
    _commit(spark, target, f"{_number(names[-1]) + 1 if names else 0}_{tag}", untouched + written)
    if keep is not None:
        _forget(spark, target, keep)


def _forget(spark: SparkSession, root: str, keep: int) -> None:
    """Drop all but the newest ``keep`` manifests and the files that only they name."""
    names = _manifests(spark, root)
    gone, kept = names[:-keep] if keep else names, names[-keep:]
    if not gone:
        return
    named = {f for n in kept for _, f in stored_files(spark, root, n)}
    for n in gone:
        for _, f in stored_files(spark, root, n):
            fs, p = _fs(spark, f"{root}/{f}")
            if f not in named and fs.exists(p):
                fs.delete(p, False)
        fs, p = _fs(spark, f"{root}/manifest/{n}")
        fs.delete(p, False)


def incremental_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, target: str,
                       checkpoint: str, keys=("series", "date"), partition: str = "date", unit: str = "month"):
    """Ingest every file that lands in ``source_dir`` into ``target``
    (``availableNow``: process what is there, then stop)."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias(ARRIVAL))
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]  # batches are numbered per checkpoint
    return (stream.writeStream.foreachBatch(lambda df, bid: upsert_batch(df, bid, target, keys, run, partition, unit))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# --- T2 ---------------------------------------------------------------------------

def daily_weather_windows(obs: DataFrame, ts: str = "timestamp", key: str = "airport",
                          watermark: str = "2 hours", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Per key and window: mean temperature, max wind, total precipitation,
    observation count. With ``slide`` the windows overlap, one beginning every
    ``slide``. An observation that the watermark has passed reaches no window that is
    closed already, only the later ones of an overlap; a window is emitted once the
    watermark passes its end (append mode)."""
    w = obs.withWatermark(ts, watermark).groupBy(F.col(key), F.window(ts, window, slide or window).alias("w"))
    return w.agg(F.avg("temperature").alias("avg_temperature"), F.max("wind_speed").alias("max_wind_speed"),
                 F.sum("precipitation").alias("total_precipitation"), F.count(F.lit(1)).alias("observations")) \
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "avg_temperature", "max_wind_speed", "total_precipitation", "observations")


# --- T3 / M6 ----------------------------------------------------------------------

ORDER_OUT = T.StructType([
    T.StructField("account", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("accepted", T.BooleanType()),
    T.StructField("message", T.StringType()),
])


# The texts of the static checks.
STATIC_FAULTS = (
    "Size must be positive", f"Size exceeds maximum ({MAX_CONTRACTS_PER_TRADE} contracts)",
    "Price must be between 0 and 1", "Side must be 'yes' or 'no'")


def static_check(size: str = "size", price: str = "price", side: str = "side") -> tuple:
    """M6 checks that need no history: size 1..max, 0 < price < 1, side."""
    msg = (F.when(F.col(size) <= 0, F.lit(STATIC_FAULTS[0]))
           .when(F.col(size) > MAX_CONTRACTS_PER_TRADE, F.lit(STATIC_FAULTS[1]))
           .when((F.col(price) <= 0) | (F.col(price) >= 1), F.lit(STATIC_FAULTS[2]))
           .when(~F.lower(F.col(side)).isin("yes", "no"), F.lit(STATIC_FAULTS[3])))
    return msg.isNull(), msg


def order_cooldown_stream(orders: DataFrame, cooldown_seconds: float = TRADE_COOLDOWN_SECONDS) -> DataFrame:
    """Accept an order only if ``cooldown_seconds`` passed since the
    account's last *accepted* order; the state is that one timestamp.

    All of an account's orders of a micro-batch are ordered by time first,
    however many Arrow batches they arrive in. An order older than the last
    accepted one arrived late: it is rejected, as accepting it would depend on
    the order of arrival."""
    ok, msg = static_check()
    x = orders.select("account", "event_id", "ts", ok.alias("static_ok"), msg.alias("static_msg"))

    def step(key, pdfs, state):
        last = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"], kind="stable").reset_index(drop=True)
        valid = rows.index[rows["static_ok"]]
        times = pd.to_datetime(rows["ts"]).loc[valid]
        wait = pd.Timedelta(seconds=cooldown_seconds)
        accepted = []
        # One step per accepted order: the next is the first past the wait.
        at = 0 if last is None else times.searchsorted(last + wait, side="left")
        while at < len(valid):
            accepted.append(valid[at])
            last = times.iloc[at]
            at = max(at + 1, times.searchsorted(last + wait, side="left"))
        if last is not None:
            state.update((last.to_pydatetime(),))
        took = rows.index.isin(accepted)
        yield pd.DataFrame({
            "account": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "accepted": took,
            "message": rows["static_msg"].where(~rows["static_ok"], pd.Series(took).map({True: "Order validated", False: "cooldown"})),
        })[[f.name for f in ORDER_OUT.fields]]

    return x.groupBy("account").applyInPandasWithState(
        step, ORDER_OUT, "last_accepted timestamp", "append", GroupStateTimeout.NoTimeout)


class OrderValidator(StatefulProcessor):
    """Answers an account's orders in the order of their times, whatever the order of
    their arrival. Orders wait until the watermark passes them; what is kept of
    those answered is the time of the last accepted one, for a cooldown."""

    def __init__(self, cooldown_us: int):
        self.cooldown_us = cooldown_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")
        self.waiting = handle.getListState("waiting", "us bigint, event_id bigint, able boolean, message string")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        orders = [(int(u), int(e), bool(a), m) for u, e, a, m in zip(new["us"], new["event_id"], new["able"], new["message"])]
        self.waiting.appendList(orders)
        # One timer, at the earliest order; more are harmless.
        self.handle.registerTimer(-(-min(o[0] for o in orders) // 1000))
        yield pd.DataFrame(columns=VALIDATED_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        orders = sorted(tuple(o) for o in self.waiting.get()) if self.waiting.exists() else []
        due = [o for o in orders if o[0] <= now * 1000]
        later = orders[len(due):]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for us, event_id, able, message in due:
            if message in STATIC_FAULTS:
                out.append((event_id, us, False, message))
            elif last is not None and us - last < self.cooldown_us:
                out.append((event_id, us, False, "cooldown"))
            elif able:
                last = us
                out.append((event_id, us, True, "Order validated"))
            else:
                out.append((event_id, us, False, message))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        else:
            self.waiting.clear()
        if last is not None:
            over = -(-(last + self.cooldown_us) // 1000)
            if over <= now and not later:
                self.last.clear()
            else:
                self.last.update((last,))
                if over > now:
                    self.handle.registerTimer(over)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=VALIDATED_COLUMNS)

    def close(self) -> None:
        pass


VALIDATED_COLUMNS = ["account", "event_id", "us", "accepted", "message"]


def order_validation_stream(orders: DataFrame, cooldown_seconds: float = TRADE_COOLDOWN_SECONDS,
                            state: DataFrame | None = None, lateness: str = "10 minutes") -> DataFrame:
    """T3 with M6's checks: static checks, cooldown and, with a static account ``state``
    (exposure, capital, last P&L), the risk limits, on a stream of orders that arrive in
    any order. The answers are those of :func:`order_cooldown_batch`; an order is
    answered once the watermark (``lateness`` behind the newest) has passed it, and one
    that arrives after that is dropped, as its place has been decided without it.

    State is bounded: the orders of the last ``lateness`` and, for a cooldown, one time
    per account; timers clear both. Needs the RocksDB state store provider."""
    ok, msg = static_check()
    x = orders.withWatermark("ts", lateness).withColumn("_fault", msg)
    if state is not None:
        x = risk.check_limits(x.join(state, "account", "left"), "size", "price")
    else:
        x = x.withColumn("passes", F.lit(True)).withColumn("reason", F.lit(""))
    able = F.col("_fault").isNull() & F.coalesce("passes", F.lit(True))
    x = x.select("account", "event_id", "ts", F.unix_micros("ts").alias("us"), able.alias("able"),
                 F.coalesce("_fault", F.concat(F.lit("Risk limit: "), F.coalesce("reason", F.lit("")))).alias("message"))
    cooldown_us = max(int(cooldown_seconds * 1_000_000), 1)
    out = x.groupBy("account").transformWithStateInPandas(
        OrderValidator(cooldown_us), "account string, event_id bigint, us bigint, accepted boolean, message string",
        "Append", "EventTime")
    return out.select("account", "event_id", F.timestamp_micros("us").alias("ts"), "accepted", "message")


class Jumps:
    """Where a stretch of time takes an account, as a step function: with a threshold
    T (no order is accepted before it), the stretch leaves the threshold
    ``exits[k]`` for the least k with T <= ``breaks[k]``, and T itself beyond them."""

    def __init__(self, breaks, exits):
        breaks, exits = np.asarray(breaks, np.int64), np.asarray(exits, np.int64)
        last = np.append(exits[1:] != exits[:-1], True) if len(exits) else np.zeros(0, bool)
        self.breaks, self.exits = breaks[last], exits[last]  # of steps that lead alike, the widest

    @classmethod
    def of_times(cls, times, cooldown: int):
        """Of sorted times at which an order would be accepted if the account is free."""
        times = np.unique(np.asarray(times, np.int64))
        n = len(times)
        # Each accepted order leads to the first one past its cooldown; the last
        # one of the chain is found by doubling the steps.
        ahead = np.searchsorted(times, times + cooldown)
        final = np.where(ahead < n, ahead, np.arange(n))
        while n and (further := final[final]).tolist() != final.tolist():
            final = further
        return cls(times, times[final] + cooldown)

    def __call__(self, t: np.ndarray) -> np.ndarray:
        t = np.asarray(t, np.int64)
        if not len(self.breaks):
            return t
        k = np.searchsorted(self.breaks, t, side="left")
        return np.where(k < len(self.breaks), self.exits[np.minimum(k, len(self.breaks) - 1)], t)

    def then(self, later: "Jumps") -> "Jumps":
        beyond = later.breaks > self.breaks[-1] if len(self.breaks) else np.ones(len(later.breaks), bool)
        return Jumps(np.concatenate([self.breaks, later.breaks[beyond]]), np.concatenate([later(self.exits), later.exits[beyond]]))


#: The threshold of an account that has accepted nothing.
FREE = np.iinfo(np.int64).min // 2
JUMPS = "breaks array<bigint>, exits array<bigint>"


def slot_thresholds(able: DataFrame, cooldown: int) -> DataFrame:
    """The threshold at which an account enters each of its time slots.

    ``able`` holds the distinct (``account``, ``_slot``, ``_us``) at which an order could be
    accepted, and a null time for slots to be known though they have none. A slot's
    orders become a step function of the threshold, by itself; the functions, of a few
    steps each, are then applied along the slots of an account (their number is bounded
    by the time covered, not by the orders). So an account without a gap is spread
    over all tasks."""

    def slot_jumps(key, pdf: pd.DataFrame) -> pd.DataFrame:
        jumps = Jumps.of_times(pdf["_us"].dropna().to_numpy(np.int64), cooldown)
        return pd.DataFrame({"account": [key[0]], "_slot": [key[1]], "breaks": [jumps.breaks], "exits": [jumps.exits]})

    def along(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, threshold, enter = pdf.sort_values("_slot"), np.array([FREE]), []
        for breaks, exits in zip(pdf["breaks"], pdf["exits"]):
            enter.append(int(threshold[0]))
            threshold = Jumps(breaks, exits)(threshold)
        return pd.DataFrame({"account": key[0], "_slot": pdf["_slot"], "_enter": enter})

    slots = able.groupBy("account", "_slot").applyInPandas(slot_jumps, f"account string, _slot bigint, {JUMPS}")
    return slots.groupBy("account").applyInPandas(along, "account string, _slot bigint, _enter bigint")


def order_cooldown_batch(orders: DataFrame, cooldown_seconds: float = TRADE_COOLDOWN_SECONDS,
                         state: DataFrame | None = None) -> DataFrame:
    """M6 / T3 in batch: static checks, then the cooldown since the account's last
    accepted order, then, with an account ``state`` (M2: exposure, capital, last
    P&L), the risk limits. An order that a limit rejects starts no cooldown.

    Which orders are accepted is a chain of jumps through an account's time. The
    chain is cut into time slots (:func:`slot_thresholds`); given the threshold at
    which it enters, each slot is walked by itself.
    """
    ok, msg = static_check()
    x = orders.withColumn("_msg", msg)
    if state is not None:
        x = risk.check_limits(x.join(state, "account", "left"), "size", "price")
    else:
        x = x.withColumn("passes", F.lit(True)).withColumn("reason", F.lit(""))
    cd = max(int(cooldown_seconds * 1_000_000), 1)
    x = x.select(
        "account", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"), "_msg",
        (F.col("_msg").isNull() & F.coalesce("passes", F.lit(True))).alias("_able"), F.coalesce("reason", F.lit("")).alias("_reason"))
    x = x.withColumn("_slot", F.floor(F.col("_us") / (cd * SLOT_COOLDOWNS)))
    able = x.where("_msg is null").select("account", "_slot", F.when(F.col("_able"), F.col("_us")).alias("_us")).distinct()
    enter = slot_thresholds(able, cd).withColumnsRenamed({"account": "_a", "_slot": "_s"})
    x = x.join(enter, F.col("account").eqNullSafe(F.col("_a")) & (F.col("_slot") == F.col("_s")), "left").drop("_a", "_s")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_us", "event_id"], kind="stable")
        times, sound = pdf["_us"].to_numpy(), pdf["_msg"].isna().to_numpy()
        able = np.flatnonzero(pdf["_able"].to_numpy(bool))
        starting, taken = times[able], []
        enter = pdf["_enter"].iloc[0]
        enter = FREE if pd.isna(enter) else int(enter)  # only orders that fail a static check
        at = int(np.searchsorted(starting, enter, side="left"))
        while at < len(able):
            taken.append(able[at])
            at = max(at + 1, int(np.searchsorted(starting, starting[at] + cd, side="left")))
        accepted = np.zeros(len(pdf), bool)
        accepted[taken] = True
        last = np.maximum.accumulate(np.where(accepted, np.arange(len(pdf)), -1))
        free = np.where(last >= 0, times[np.maximum(last, 0)] + cd, enter)
        limited = "Risk limit: " + pdf["_reason"].astype(str)
        message = np.where(~sound, pdf["_msg"], np.where(accepted, "Order validated", np.where(times < free, "cooldown", limited)))
        return pd.DataFrame({"account": pdf["account"], "event_id": pdf["event_id"], "ts": pdf["ts"],
                             "accepted": accepted, "message": message})

    kinds = dict(x.dtypes)
    schema = f"account string, event_id {kinds['event_id']}, ts {kinds['ts']}, accepted boolean, message string"
    return x.groupBy("account", "_slot").applyInPandas(walk, schema)


# --- T4 ---------------------------------------------------------------------------

def running_daily_pnl(trades: DataFrame, limits: DataFrame, ts: str = "ts", account: str = "account",
                      watermark: str = "1 day") -> DataFrame:
    """T4: per account and day, the P&L and gross exposure so far (update
    mode), joined to a static per-account limits table (``daily_loss_limit``)
    with a breach flag."""
    signed = F.when(F.col("side") == "yes", F.col("size")).otherwise(-F.col("size"))
    g = (trades.withWatermark(ts, watermark)
         .groupBy(F.col(account), F.window(ts, "1 day").alias("w"))
         .agg(F.sum("pnl").alias("daily_pnl"), F.sum(F.abs(signed)).alias("gross_exposure")))
    j = g.join(limits, account, "left")
    return j.select(account, F.col("w.start").alias("day"), "daily_pnl", "gross_exposure",
                    (F.col("daily_pnl") < -F.col("daily_loss_limit")).alias("limit_breached"))
