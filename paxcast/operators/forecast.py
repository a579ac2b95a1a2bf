"""Weekly blend forecast (I1) and the reports built on it.

For week ``i`` of a gap-free weekly series ``t``::

    ly   = t[i-52]                       same week last year
    r4   = mean t[i-4 .. i-1]            recent four weeks
    cur  = mean t[i-52 .. i-1]           trailing year
    prev = mean t[i-104 .. i-53]         the year before
    g    = cur/prev - 1 if i >= 104 and prev > 0 else default_growth
    pred = 0.3 * ly * (1 + g) + 0.7 * r4
    unc  = max(stddev_samp t[i-12 .. i-1], 0.03 * pred)

Every week of every series is forecast in one pass: all frames share one
``Window.partitionBy(key).orderBy(week_end)``, so Spark plans a single
exchange and sort for the lot. The frames end at -1, so no forecast reads
its own week (no look-ahead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paxcast.functions.stats import full_frame, safe_div
from paxcast.operators import resample

# Fixed values of the blend.
WEIGHT_LAST_YEAR = 0.3
WEIGHT_RECENT = 0.7
MIN_UNCERTAINTY_FRACTION = 0.03
MIN_WEEKS = 52
Z95 = 1.96


def blend_forecast(dense: DataFrame, key: str = "series", default_growth: float = 0.0,
                   min_weeks: int = MIN_WEEKS) -> DataFrame:
    """I1 over a dense weekly table ``(key, week_end, total, ...)``.

    Returns the input columns plus ``week_idx, prediction, uncertainty``;
    weeks with fewer than ``min_weeks`` earlier weeks are dropped.
    """
    w = Window.partitionBy(key).orderBy("week_end")
    t = "total"
    idx = F.row_number().over(w) - 1
    x = dense.select(
        "*",
        idx.alias("week_idx"),
        F.lag(t, 52).over(w).alias("_ly"),
        F.avg(t).over(w.rowsBetween(-4, -1)).alias("_r4"),
        F.avg(t).over(w.rowsBetween(-52, -1)).alias("_cur"),
        F.avg(t).over(w.rowsBetween(-104, -53)).alias("_prev"),
        F.stddev_samp(t).over(w.rowsBetween(-12, -1)).alias("_sd12"),
    )
    # Two years of history: trailing-year growth (0 when the earlier year is
    # empty). Less than two years: the caller's default growth.
    growth = (F.when(F.col("week_idx") >= 104,
                     F.when(F.col("_prev") > 0, F.col("_cur") / F.col("_prev") - 1.0).otherwise(F.lit(0.0)))
              .otherwise(F.lit(float(default_growth))))
    pred = WEIGHT_LAST_YEAR * F.col("_ly") * (1.0 + growth) + WEIGHT_RECENT * F.col("_r4")
    x = x.where(F.col("week_idx") >= min_weeks).withColumn("prediction", pred)
    unc = F.greatest(F.col("_sd12"), MIN_UNCERTAINTY_FRACTION * F.col("prediction"))
    return x.withColumn("uncertainty", unc).drop("_ly", "_r4", "_cur", "_prev", "_sd12")


def weekly_forecast(daily: DataFrame, key: str = "series", date: str = "date", value: str = "passengers",
                    default_growth: float = 0.0) -> DataFrame:
    """H1 + I1: forecast and 95% band for every week with a year of history."""
    dense = resample.weekly_totals(daily, key, date, value)
    f = blend_forecast(dense, key, default_growth)
    return f.select(
        key, "week_end", "week_idx", F.col("total").alias("actual"), "prediction", "uncertainty",
        (F.col("prediction") - Z95 * F.col("uncertainty")).alias("lower_bound"),
        (F.col("prediction") + Z95 * F.col("uncertainty")).alias("upper_bound"),
    )


def next_week_forecast(daily: DataFrame, key: str = "series", date: str = "date", value: str = "passengers",
                       default_growth: float = 0.05) -> DataFrame:
    """Forecast of the week after the last complete week, one row per key.

    An incomplete final week (fewer than 7 days) is not averaged in; it is the
    week being forecast. Keys with fewer than 52 weeks get a row with null
    figures and an ``error`` text.
    """
    weekly = resample.weekly_sums(daily, key, date, value)
    dense = resample.densify_weeks(weekly, key, extend_future=True, drop_incomplete_last=True)
    f = blend_forecast(dense, key, default_growth, min_weeks=0)
    enough = F.col("week_idx") >= MIN_WEEKS
    pred = F.when(enough, F.col("prediction"))
    unc = F.when(enough, F.col("uncertainty"))
    cv = F.when(pred > 0, unc / pred).otherwise(F.lit(1.0))
    return f.where(F.col("is_future")).select(
        key, "week_end", F.col("week_idx").alias("weeks_of_history"),
        pred.alias("prediction"), unc.alias("uncertainty"),
        F.when(enough, 1.0 / (1.0 + cv)).alias("confidence"),
        (pred - Z95 * unc).alias("lower_bound"),
        (pred + Z95 * unc).alias("upper_bound"),
        F.when(~enough, F.lit("Insufficient historical data")).alias("error"),
    )


def _complete(min_actual: float):
    """A week with all its days and a total of at least ``min_actual`` (above 0)."""
    return (F.col("n_days") == 7) & (F.col("total") > 0) & (F.col("total") >= min_actual)


def accuracy_history(daily: DataFrame, key: str = "series", date: str = "date", value: str = "passengers",
                     days: int = 30, min_actual: float = 0.0, first_idx: int = 53) -> DataFrame:
    """Accuracy of the last ``max(days // 7, 4)`` complete weeks per key.

    Weeks before index ``first_idx`` and incomplete weeks (fewer than seven
    days, nothing counted, or a total below ``min_actual``) are skipped.
    """
    f = _accuracy_weeks(daily, key, date, value, days, min_actual, first_idx).where("_keep")
    return f.select(key, "date", "predicted", "actual", "accuracy")


def _accuracy_weeks(daily, key, date, value, days, min_actual, first_idx) -> DataFrame:
    """Every week of every key with its accuracy and whether it counts (``_keep``)."""
    n_weeks = max(days // 7, 4)
    weekly = resample.weekly_sums(daily, key, date, value)
    dense = resample.densify_weeks(weekly, key, drop_incomplete_last=True)
    f = blend_forecast(dense, key, 0.0)
    wl = Window.partitionBy(key)
    last_idx = F.max("week_idx").over(wl)
    f = f.withColumn("_last", last_idx)
    keep = (F.col("week_idx") >= F.greatest(F.lit(first_idx), F.col("_last") - n_weeks)) & \
           _complete(min_actual)
    acc = F.least(F.greatest(1.0 - F.abs(F.col("prediction") - F.col("total")) / F.col("total"), F.lit(0.0)),
                  F.lit(1.0))
    return f.select(
        key, F.col("week_end").alias("date"), F.col("prediction").alias("predicted"),
        F.col("total").alias("actual"), acc.alias("accuracy"), F.coalesce(keep, F.lit(False)).alias("_keep"),
    )


def historical_performance(daily: DataFrame, key: str = "series", date: str = "date",
                           value: str = "passengers", start_date: str | None = None,
                           min_actual: float = 0.0) -> DataFrame:
    """I4: every forecastable complete week from ``start_date`` except the final one, with errors."""
    dense = resample.weekly_totals(daily, key, date, value)
    f = blend_forecast(dense, key, 0.0)
    f = f.withColumn("_last", F.max("week_idx").over(Window.partitionBy(key)))
    keep = (F.col("week_idx") < F.col("_last")) & _complete(min_actual)
    if start_date is not None:
        keep = keep & (F.col("week_end") >= F.to_date(F.lit(start_date)))
    err = F.col("prediction") - F.col("total")
    acc = F.least(F.greatest(1.0 - F.abs(err) / F.col("total"), F.lit(0.0)), F.lit(1.0))
    return f.where(keep).select(
        key, F.col("week_end").alias("date"), F.col("prediction").alias("predicted"),
        F.col("total").alias("actual"), acc.alias("accuracy"), err.alias("error"),
        (err / F.col("total") * 100.0).alias("error_pct"),
    )


def performance_summary(perf: DataFrame, key: str = "series") -> DataFrame:
    """Weeks, mean accuracy, daily RMSE and MAE (weekly / 7), MAPE %."""
    err = F.col("error")
    return perf.groupBy(key).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.avg("accuracy").alias("mean_accuracy"),
        (F.sqrt(F.avg(err * err)) / 7.0).alias("rmse_daily"),
        (F.avg(F.abs(err)) / 7.0).alias("mae_daily"),
        (F.avg(F.abs(err) / F.col("actual")) * 100.0).alias("mape_pct"),
    )


def recent_performance(daily: DataFrame, key: str = "series", date: str = "date", value: str = "passengers",
                       days: int = 30, min_actual: float = 0.0, first_idx: int = 53) -> DataFrame:
    """mean/std accuracy, RMSE, MAE over the accuracy history; zeros for keys
    without a week that counts. Keys come with the weeks, from one scan."""
    weeks = _accuracy_weeks(daily, key, date, value, days, min_actual, first_idx)
    keep = F.col("_keep")
    accuracy, err = F.when(keep, F.col("accuracy")), F.when(keep, F.col("predicted") - F.col("actual"))
    agg = weeks.groupBy(key).agg(
        F.avg(accuracy).alias("mean_accuracy"), F.stddev_samp(accuracy).alias("accuracy_std"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
    )
    return agg.select(key, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                             for c in ("mean_accuracy", "accuracy_std", "rmse", "mae")])


def daily_view(forecast: DataFrame, key: str = "series", last_n: int | None = 12) -> DataFrame:
    """Weekly figures as daily averages (/ 7); optionally the last ``n`` weeks per key."""
    cols = [c for c in ("prediction", "actual", "lower_bound", "upper_bound", "uncertainty") if c in forecast.columns]
    out = forecast.select(key, "week_end", *[(F.col(c) / 7.0).alias(f"daily_{c}") for c in cols])
    if last_n is not None:
        w = Window.partitionBy(key).orderBy(F.col("week_end").desc())
        out = out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last_n).drop("_rn")
    return out


def rolling_accuracy(history: DataFrame, key: str = "series", window: int = 7,
                     target: float = 0.85) -> DataFrame:
    """I8: rolling mean accuracy (null until the window is full) against a target line."""
    w = Window.partitionBy(key).orderBy("date")
    roll = full_frame(F.avg, "accuracy", w, -(window - 1), 0)
    return history.select(key, "date", "accuracy", roll.alias("rolling_accuracy"),
                          F.lit(float(target)).alias("target"))


def confidence_band(pred: DataFrame, predicted: str = "predicted", confidence: str = "confidence") -> DataFrame:
    """Band ``pred +/- pred * (1 - confidence) * 0.1``."""
    half = F.col(predicted) * (1.0 - F.col(confidence)) * 0.1
    return pred.withColumn("band_lower", F.col(predicted) - half).withColumn("band_upper", F.col(predicted) + half)
