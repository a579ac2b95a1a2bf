"""Resampling: daily rows to gap-free weekly totals, latest values, daily P&L.

Weeks end on Sunday. Raw rows are reduced to ``(key, week_end)`` with a
partial (map-side) aggregate, so a hot key costs one row per task and week
before the shuffle. Gap weeks are filled inside the window pass that already
partitions by the key (``lead`` + ``explode(sequence)``) instead of joining a
separate spine, which saves a shuffle and a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _interval(text: str):
    return F.expr(f"INTERVAL {text}")



def week_end(date: Column | str) -> Column:
    """Sunday that closes the (Monday-first) week of ``date``."""
    d = F.col(date) if isinstance(date, str) else date
    return F.next_day(F.date_sub(d, 1), "Sun")


def weekly_sums(daily: DataFrame, key: str = "series", date: str = "date",
                value: str = "passengers") -> DataFrame:
    """``(key, week_end, total, n_days)``: sparse weekly sums (one shuffle, partial agg)."""
    return daily.groupBy(F.col(key), week_end(date).alias("week_end")).agg(
        F.sum(F.coalesce(F.col(value), F.lit(0.0))).cast("double").alias("total"),
        F.count(F.col(value)).alias("n_days"),
    )


def densify_weeks(weekly: DataFrame, key: str = "series", extend_future: bool = False,
                  drop_incomplete_last: bool = False) -> DataFrame:
    """Fill missing weeks with 0 between each key's first and last week.

    Adds ``is_future``. With ``extend_future`` one future week per key is
    appended with a null total: the week after the last complete week (an
    incomplete final week, ``n_days < 7``, becomes that future week when
    ``drop_incomplete_last`` is set).
    """
    w = Window.partitionBy(key).orderBy("week_end")
    nxt = F.lead("week_end").over(w)
    x = weekly.withColumn("_next", nxt)
    is_last = F.col("_next").isNull()
    incomplete_last = is_last & (F.col("n_days") < 7) if drop_incomplete_last else F.lit(False)
    if extend_future:
        stop = F.when(is_last & ~incomplete_last, F.date_add("week_end", 7)).when(is_last, F.col("week_end"))
    else:
        stop = F.when(is_last, F.col("week_end"))
    stop = F.coalesce(stop, F.date_sub("_next", 7))
    x = x.withColumn("_drop_self", incomplete_last if extend_future else F.lit(False))
    if drop_incomplete_last and not extend_future:
        # The incomplete last week is removed outright.
        x = x.where(~incomplete_last)
    x = x.withColumn("_wk", F.explode(F.sequence(F.col("week_end"), stop, _interval("7 DAYS"))))
    future = F.lit(False)
    if extend_future:
        future = is_last & ((F.col("_wk") > F.col("week_end")) | F.col("_drop_self"))
    total = (F.when(future, F.lit(None).cast("double"))
             .when(F.col("_wk") == F.col("week_end"), F.col("total"))
             .otherwise(F.lit(0.0)))
    n_days = F.when(future, F.lit(0)).when(F.col("_wk") == F.col("week_end"), F.col("n_days")).otherwise(F.lit(0))
    return x.select(
        F.col(key), F.col("_wk").alias("week_end"), total.alias("total"),
        n_days.cast("bigint").alias("n_days"), future.alias("is_future"),
    )


def weekly_totals(daily: DataFrame, key: str = "series", date: str = "date",
                  value: str = "passengers") -> DataFrame:
    """H1: gap-free weekly totals (empty weeks = 0) per key."""
    return densify_weeks(weekly_sums(daily, key, date, value), key).drop("is_future")


def latest_value(daily: DataFrame, key: str = "series", date: str = "date",
                 value: str = "passengers") -> DataFrame:
    """H2: latest value per key and its year-over-year change.

    ``max_by`` keeps one row per key without sorting the key's history. The
    prior-year value is the same calendar date twelve months earlier.
    """
    latest = daily.groupBy(key).agg(
        F.max_by(F.struct(F.col(date).alias("date"), F.col(value).alias("value")), F.col(date)).alias("l")
    ).select(key, F.col("l.date").alias("date"), F.col("l.value").alias("value"))
    latest = latest.withColumn("prior_date", F.add_months("date", -12))
    prior = daily.select(F.col(key), F.col(date).alias("prior_date"), F.col(value).alias("prior_value"))
    out = latest.join(prior, [key, "prior_date"], "left")
    yoy = F.when(F.col("value") > 0, F.try_divide(F.col("value") - F.col("prior_value"),
                                                 F.nullif(F.col("prior_value"), F.lit(0.0))))
    return out.select(key, "date", "value", "prior_value", yoy.alias("yoy_change"))


def daily_pnl(trades: DataFrame, key: str = "account", ts: str = "ts", pnl: str = "pnl") -> DataFrame:
    """H3: daily P&L per key (0 on days without trades) and its running total."""
    per_day = trades.groupBy(F.col(key), F.to_date(ts).alias("date")).agg(F.sum(pnl).alias("pnl"))
    w = Window.partitionBy(key).orderBy("date")
    x = per_day.withColumn("_next", F.lead("date").over(w))
    stop = F.coalesce(F.date_sub("_next", 1), F.col("date"))
    x = x.withColumn("_d", F.explode(F.sequence(F.col("date"), stop, _interval("1 DAY"))))
    dense = x.select(F.col(key), F.col("_d").alias("date"),
                     F.when(F.col("_d") == F.col("date"), F.col("pnl")).otherwise(F.lit(0.0)).alias("daily_pnl"))
    w2 = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("cumulative_pnl", F.sum("daily_pnl").over(w2))
