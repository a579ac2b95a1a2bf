"""Point-in-time (look-ahead-safe) access to data.

A row of a source becomes usable ``delay`` hours after its timestamp. With a
single source type the availability test is ``ts <= reference - delay``: a
literal bound that Parquet can push down. The as-of join is bucketed by time
so that a hot key is spread over its buckets instead of one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Availability delay in hours per source type.
DATA_DELAYS_HOURS = {
    "tsa": 24,
    "weather": 1,
    "airlines": 48,
    "hotels": 72,
    "economic": 168,
}


def delay_dim(spark: SparkSession) -> DataFrame:
    """``(data_type, delay_hours)``: five rows, broadcast everywhere."""
    return spark.createDataFrame(sorted(DATA_DELAYS_HOURS.items()), "data_type string, delay_hours int")


def _as_ts(ref) -> dt.datetime:
    if isinstance(ref, str):
        return dt.datetime.fromisoformat(ref)
    if isinstance(ref, dt.datetime):
        return ref
    return dt.datetime.combine(ref, dt.time())


def available(df: DataFrame, data_type: str, reference_time, ts: str = "timestamp") -> DataFrame:
    """G1 for one source: rows with ``ts + delay <= reference_time`` (pushed-down bound)."""
    if data_type not in DATA_DELAYS_HOURS:
        raise ValueError(f"Unknown data type: {data_type}")
    bound = _as_ts(reference_time) - dt.timedelta(hours=DATA_DELAYS_HOURS[data_type])
    return df.where(F.col(ts) <= F.lit(bound).cast("timestamp_ntz"))


def available_by_type(df: DataFrame, reference_time, type_col: str = "data_type",
                      ts: str = "timestamp") -> DataFrame:
    """G1 for a mixed table: delay looked up per row; an unknown type among
    the rows old enough to be usable at all fails the job (rows newer than
    the shortest delay are cut at the scan before the lookup)."""
    spark = df.sparkSession
    ref = F.lit(_as_ts(reference_time)).cast("timestamp_ntz")
    # The shortest delay bounds every type: a literal filter that reaches the
    # scan before the per-type check.
    bound = _as_ts(reference_time) - dt.timedelta(hours=min(DATA_DELAYS_HOURS.values()))
    df = df.where(F.col(ts) <= F.lit(bound).cast("timestamp_ntz"))
    j = df.join(F.broadcast(delay_dim(spark)).withColumnRenamed("data_type", type_col), type_col, "left")
    checked = F.when(F.col("delay_hours").isNull(),
                     F.raise_error(F.concat(F.lit("Unknown data type: "), F.col(type_col).cast("string"))))
    return (j.where(F.coalesce(checked.cast("boolean"), F.lit(True)))
            .where(F.col(ts) + F.make_dt_interval(hours=F.col("delay_hours")) <= ref)
            .drop("delay_hours"))


def latest_available(spark: SparkSession, reference_time) -> DataFrame:
    """Latest usable timestamp per source type."""
    ref = F.lit(_as_ts(reference_time)).cast("timestamp_ntz")
    return delay_dim(spark).select(
        "data_type", (ref - F.make_dt_interval(hours=F.col("delay_hours"))).alias("latest_available"))


def latest_available_for(df: DataFrame, reference_time, type_col: str = "data_type",
                         ts: str = "timestamp") -> DataFrame:
    """G2 over a mixed table: for each source type present, the latest usable
    timestamp, the latest row that is actually usable and the row count.

    One aggregation per type (partial before the shuffle); the five-row delay
    dimension is broadcast.
    """
    ref = F.lit(_as_ts(reference_time)).cast("timestamp_ntz")
    d = F.broadcast(delay_dim(df.sparkSession).withColumnRenamed("data_type", type_col))
    bound = ref - F.make_dt_interval(hours=F.col("delay_hours"))
    j = df.select(type_col, ts).join(d, type_col, "left")
    # An unknown source type is an error, as in the row filter.
    j = j.withColumn("delay_hours", F.when(F.col("delay_hours").isNotNull(), F.col("delay_hours")).otherwise(
        F.raise_error(F.concat(F.lit("Unknown data type: "), F.coalesce(F.col(type_col).cast("string"), F.lit("null")))).cast("int")))
    return j.groupBy(type_col, "delay_hours").agg(
        F.max(F.when(F.col(ts) <= bound, F.col(ts))).alias("latest_row"),
        F.count(F.lit(1)).alias("rows_total"),
    ).select(type_col, (ref - F.make_dt_interval(hours=F.col("delay_hours"))).alias("latest_available"),
             "latest_row", "rows_total")


def validate_timeline(df: DataFrame, feature_timestamps: dict[str, str], reference_time) -> DataFrame:
    """Per feature type, whether every row meets its delay, and the violations.

    ``feature_timestamps`` maps a source type to the timestamp column it
    feeds. The columns are unpivoted into ``(data_type, ts)`` rows and
    checked in one aggregation.
    """
    ref = F.lit(_as_ts(reference_time)).cast("timestamp_ntz")
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("data_type"), F.col(c).cast("timestamp_ntz").alias("ts"))
        for t, c in feature_timestamps.items()])).alias("s")).select("s.*")
    j = stacked.join(F.broadcast(delay_dim(df.sparkSession)), "data_type", "left")
    ok = (F.col("ts") + F.make_dt_interval(hours=F.col("delay_hours"))) <= ref
    return j.groupBy("data_type").agg(
        F.bool_and(ok).alias("valid"),
        F.sum((~ok).cast("int")).cast("bigint").alias("violations"),
        F.count(F.lit(1)).alias("rows"),
    )


def asof_join(cutoffs: DataFrame, facts: DataFrame, key: str, cutoff: str, fact_time: str,
              value_cols: list[str], strict: bool = False, bucket: str = "hour") -> DataFrame:
    """For each ``(key, cutoff)`` the latest fact with ``fact_time <= cutoff``
    (``<`` when ``strict``), its values and its time as ``asof_time``.

    Both sides are cut into time buckets; a window per ``(key, bucket)``
    finds the latest fact inside the cutoff's bucket, and a small per-key
    table of each bucket's last fact carries values across empty buckets.
    Work per task is bounded by one key-bucket, never a whole hot key.
    """
    payload = F.struct(F.col(fact_time).alias("asof_time"), *[F.col(c) for c in value_cols])
    f = facts.select(F.col(key), F.col(fact_time).alias("_t"), F.lit(1).alias("_kind"), payload.alias("_p"))
    # Order inside equal times: facts before cutoffs when inclusive, after when strict.
    fact_rank, cut_rank = (1, 0) if strict else (0, 1)
    f = f.withColumn("_ord", F.lit(fact_rank))
    c = cutoffs.select(F.col(key), F.col(cutoff).alias("_t"), F.lit(0).alias("_kind"),
                       F.lit(None).cast(f.schema["_p"].dataType).alias("_p"), F.lit(cut_rank).alias("_ord"),
                       F.col(cutoff).alias("_cutoff"))
    f = f.withColumn("_cutoff", F.lit(None).cast(c.schema["_cutoff"].dataType))
    tl = f.unionByName(c).withColumn("_b", F.date_trunc(bucket, F.col("_t")))
    w = (Window.partitionBy(key, "_b").orderBy("_t", "_ord")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tl = tl.withColumn("_in", F.last("_p", ignorenulls=True).over(w))
    hits = tl.where(F.col("_kind") == 0).select(key, "_b", "_cutoff", "_in")
    # Last fact of each bucket, carried forward to later buckets.
    last_per_bucket = (facts.select(F.col(key), F.date_trunc(bucket, F.col(fact_time)).alias("_b"),
                                    F.col(fact_time).alias("_t"), payload.alias("_p"))
                       .groupBy(key, "_b").agg(F.max_by("_p", "_t").alias("_p")))
    cut_buckets = hits.select(key, "_b").distinct().withColumn("_p", F.lit(None).cast(f.schema["_p"].dataType))
    # Cut rows sort before the facts of their own bucket, so the frame that
    # ends one row earlier sees only strictly earlier buckets.
    carry_tl = last_per_bucket.withColumn("_o", F.lit(1)).unionByName(cut_buckets.withColumn("_o", F.lit(0)))
    wc = Window.partitionBy(key).orderBy("_b", "_o").rowsBetween(Window.unboundedPreceding, -1)
    carry = (carry_tl.withColumn("_carry", F.last("_p", ignorenulls=True).over(wc))
             .where(F.col("_o") == 0).select(key, "_b", "_carry"))
    out = hits.join(carry, [key, "_b"], "left")
    res = F.coalesce(F.col("_in"), F.col("_carry"))
    return out.select(F.col(key), F.col("_cutoff").alias(cutoff),
                      *[res.getField(n).alias(n) for n in ["asof_time", *value_cols]])
