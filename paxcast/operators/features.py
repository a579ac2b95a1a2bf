"""Lag features and feature matrices.

All windows are partitioned by the series key and ordered by date; lags and
rolling frames are positional (rows), as the source series is one row per
day. Rolling training features end at the row before the target (no
look-ahead) unless ``leaky=True`` is asked for explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paxcast.functions.stats import full_frame
from paxcast.operators import aggregates, calendar

DEFAULT_LAGS = (1, 7, 14, 28)


def lag_features(df: DataFrame, columns=("passengers",), lags=DEFAULT_LAGS, key: str = "series",
                 date: str = "date") -> DataFrame:
    """``{col}_lag_{k}`` for every column and lag; one shared window (one sort)."""
    w = Window.partitionBy(key).orderBy(date)
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in columns for k in lags])


def feature_matrix(daily: DataFrame, processed_weather: DataFrame | None = None,
                   processed_fares: DataFrame | None = None, key: str = "series", date: str = "date",
                   value: str = "passengers", lags=DEFAULT_LAGS, fares: DataFrame | None = None) -> DataFrame:
    """calendar + weather + fare + lag features for every ``(key, date)``.

    The calendar is a map looked up by row. Per-date feature tables are left-joined
    on ``date``; they hold one row per day, so AQE broadcasts them when small and
    shuffles otherwise. Fares come processed (C6, C7) or, read once, as they are
    (``fares``).
    """
    base = lag_features(daily.select(key, date, value), (value,), lags, key, date)
    out = calendar.with_calendar(base, date)
    if processed_weather is not None:
        out = out.join(aggregates.weather_features(processed_weather, date), date, "left")
    if fares is not None:
        out = out.join(aggregates.fare_features(fares, date=date), date, "left")
    elif processed_fares is not None:
        out = out.join(aggregates.airline_features(processed_fares, date), date, "left")
    return out


def training_matrix(daily: DataFrame, key: str = "series", date: str = "date", value: str = "passengers",
                    leaky: bool = False, complete: bool = True) -> DataFrame:
    """``day_of_week, month, is_weekend, lag_1, lag_7, rolling_mean_7, rolling_std_7``
    and the target; rows with any null feature are dropped (kept if not ``complete``).

    Rolling frames cover the 7 rows before the target; ``leaky=True``
    reproduces the original frame that includes the target row.
    """
    w = Window.partitionBy(key).orderBy(date)
    lo, hi = (-6, 0) if leaky else (-7, -1)
    x = daily.select(
        key, date, F.col(value).alias("target"),
        F.weekday(date).alias("day_of_week"),
        F.month(date).alias("month"),
        F.weekday(date).isin(5, 6).cast("int").alias("is_weekend"),
        F.lag(value, 1).over(w).alias("lag_1"),
        F.lag(value, 7).over(w).alias("lag_7"),
        full_frame(F.avg, value, w, lo, hi).alias("rolling_mean_7"),
        full_frame(F.stddev_samp, value, w, lo, hi).alias("rolling_std_7"),
    )
    return x if not complete else x.dropna(subset=["lag_1", "lag_7", "rolling_mean_7", "rolling_std_7"])


def point_features(daily: DataFrame, key: str = "series", date: str = "date",
                   value: str = "passengers") -> DataFrame:
    """for each date, weekday, month, ISO week and the mean/std of the 7 rows before it."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(-7, -1)
    return daily.select(
        key, date,
        F.weekday(date).alias("day_of_week"),
        F.month(date).alias("month"),
        F.weekofyear(date).alias("week_of_year"),
        F.avg(value).over(w).alias("recent_mean"),
        F.stddev_samp(value).over(w).alias("recent_std"),
    )


def missing_features(df: DataFrame, required) -> list[str]:
    """required feature names absent from ``df`` (schema only, no job)."""
    have = set(df.columns)
    return sorted(set(required) - have)


def validate_features(df: DataFrame, required) -> DataFrame:
    """raise before any job runs if a required feature is missing."""
    missing = missing_features(df, required)
    if missing:
        raise ValueError(f"Missing required features: {missing}")
    return df
