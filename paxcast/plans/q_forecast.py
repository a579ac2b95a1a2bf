"""Queries: weekly totals, blend forecast and the forecast reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from paxcast.operators import forecast, resample
from paxcast.plans.oracle_views import X1, with_
from paxcast.plans.registry import query, round_doubles, round_sql
from paxcast.sources import fixtures
from paxcast.sources.tables import Tables

# --- SQL building blocks over x1 --------------------------------------------

WEEKLY_SQL = """weekly AS (
  SELECT series, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end,
         SUM(COALESCE(passengers, 0.0)) AS total, COUNT(passengers) AS n_days
  FROM x1 GROUP BY 1, 2),
bounds AS (SELECT series, MIN(week_end) AS lo, MAX(week_end) AS hi FROM weekly GROUP BY 1),
spine AS (
  SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_end FROM bounds),
dense AS (
  SELECT s.series, s.week_end, COALESCE(w.total, 0.0) AS total, COALESCE(w.n_days, 0) AS n_days
  FROM spine s LEFT JOIN weekly w ON s.series = w.series AND s.week_end = w.week_end)"""


def blend_sql(src: str, default_growth: float) -> str:
    """I1 windows over a dense table ``src(series, week_end, total)``."""
    return f"""SELECT *, GREATEST(sd12, 0.03 * prediction) AS uncertainty FROM (
  SELECT *, 0.3 * ly * (1.0 + CASE WHEN week_idx >= 104 THEN (CASE WHEN prev > 0 THEN cur / prev - 1.0 ELSE 0.0 END)
                                    ELSE {default_growth!r} END) + 0.7 * r4 AS prediction
  FROM (
    SELECT {src}.*,
           ROW_NUMBER() OVER w - 1 AS week_idx,
           LAG(total, 52) OVER w AS ly,
           AVG(total) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS r4,
           AVG(total) OVER (w ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS cur,
           AVG(total) OVER (w ROWS BETWEEN 104 PRECEDING AND 53 PRECEDING) AS prev,
           STDDEV_SAMP(total) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS sd12
    FROM {src}
    WINDOW w AS (PARTITION BY series ORDER BY week_end)) a) b"""


FORECAST_COLS = ["actual", "prediction", "uncertainty", "lower_bound", "upper_bound"]

FORECAST_SQL = with_(X1, WEEKLY_SQL, f"f AS ({blend_sql('dense', 0.0)})") + """
SELECT series, week_end, CAST(week_idx AS BIGINT) AS week_idx, total AS actual, prediction, uncertainty,
       prediction - 1.96 * uncertainty AS lower_bound, prediction + 1.96 * uncertainty AS upper_bound
FROM f WHERE week_idx >= 52"""


@query("weekly_forecast", "H1 I1", round_sql(FORECAST_SQL, FORECAST_COLS, 2))
def q_weekly_forecast(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(forecast.weekly_forecast(fixtures.daily_counts(t)), 2)


@query("weekly_totals", "H1", round_sql(with_(X1, WEEKLY_SQL) + """
SELECT series, week_end, total FROM dense""", ["total"], 2))
def q_weekly_totals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(resample.weekly_totals(fixtures.daily_counts(t)).select("series", "week_end", "total"), 2)


# --- I2: next-week forecast ---------------------------------------------------

NEXT_SQL = with_(X1, WEEKLY_SQL, """mx AS (SELECT series, MAX(week_end) AS hi FROM dense GROUP BY 1),
target AS (SELECT d.series, CASE WHEN d.n_days < 7 THEN d.week_end ELSE d.week_end + 7 END AS week_end
           FROM dense d JOIN mx ON d.series = mx.series AND d.week_end = mx.hi),
dn AS (SELECT d.series, d.week_end, d.total, d.n_days, FALSE AS is_future
       FROM dense d JOIN target t ON d.series = t.series WHERE d.week_end < t.week_end
       UNION ALL SELECT series, week_end, CAST(NULL AS DOUBLE), 0, TRUE FROM target)""",
                 f"f AS ({blend_sql('dn', 0.05)})") + """
SELECT series, week_end, CAST(week_idx AS BIGINT) AS weeks_of_history,
       CASE WHEN week_idx >= 52 THEN prediction END AS prediction,
       CASE WHEN week_idx >= 52 THEN uncertainty END AS uncertainty,
       CASE WHEN week_idx >= 52 THEN 1.0 / (1.0 + CASE WHEN prediction > 0 THEN uncertainty / prediction ELSE 1.0 END)
       END AS confidence,
       CASE WHEN week_idx >= 52 THEN prediction - 1.96 * uncertainty END AS lower_bound,
       CASE WHEN week_idx >= 52 THEN prediction + 1.96 * uncertainty END AS upper_bound,
       CASE WHEN week_idx < 52 THEN 'Insufficient historical data' END AS error
FROM f WHERE is_future"""


@query("next_week_forecast", "I2", round_sql(NEXT_SQL, ["prediction", "uncertainty", "confidence",
                                                         "lower_bound", "upper_bound"], 2))
def q_next_week(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(forecast.next_week_forecast(fixtures.daily_counts(t)), 2)


# --- I3, I6, I8: accuracy history and what is computed from it -----------------

# Parameter of the registered queries.
ACCURACY_DAYS = 365

COMPLETE_SQL = f"""dc AS (
  SELECT series, week_end, total, n_days FROM (
    SELECT *, MAX(week_end) OVER (PARTITION BY series) AS hi FROM dense) z
  WHERE NOT (week_end = hi AND n_days < 7)),
fc AS ({blend_sql('dc', 0.0)}),
acc AS (
  SELECT series, week_end AS date, prediction AS predicted, total AS actual,
         LEAST(GREATEST(1.0 - abs(prediction - total) / total, 0.0), 1.0) AS accuracy
  FROM (SELECT *, MAX(week_idx) OVER (PARTITION BY series) AS last_idx FROM fc) z
  WHERE week_idx >= GREATEST(53, last_idx - {max(ACCURACY_DAYS // 7, 4)}) AND n_days = 7 AND total > 0)"""


@query("accuracy_history", "I3", round_sql(with_(X1, WEEKLY_SQL, COMPLETE_SQL) + "SELECT * FROM acc",
                                           ["predicted", "actual", "accuracy"]))
def q_accuracy_history(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(forecast.accuracy_history(fixtures.daily_counts(t), days=ACCURACY_DAYS))


RECENT_SQL = with_(X1, WEEKLY_SQL, COMPLETE_SQL) + """
SELECT k.series, COALESCE(a.mean_accuracy, 0.0) AS mean_accuracy, COALESCE(a.accuracy_std, 0.0) AS accuracy_std,
       COALESCE(a.rmse, 0.0) AS rmse, COALESCE(a.mae, 0.0) AS mae
FROM (SELECT DISTINCT series FROM x1) k LEFT JOIN (
  SELECT series, AVG(accuracy) AS mean_accuracy,
         CASE WHEN COUNT(*) > 1 THEN STDDEV_SAMP(accuracy) ELSE 0.0 END AS accuracy_std,
         sqrt(AVG((predicted - actual) * (predicted - actual))) AS rmse, AVG(abs(predicted - actual)) AS mae
  FROM acc GROUP BY 1) a ON k.series = a.series"""


@query("recent_performance", "I6", round_sql(RECENT_SQL, ["mean_accuracy", "accuracy_std", "rmse", "mae"]))
def q_recent_performance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(forecast.recent_performance(fixtures.daily_counts(t), days=ACCURACY_DAYS))


ROLLING_SQL = with_(X1, WEEKLY_SQL, COMPLETE_SQL) + """
SELECT series, date, accuracy,
       CASE WHEN COUNT(accuracy) OVER r = 7 THEN AVG(accuracy) OVER r END AS rolling_accuracy, 0.85 AS target
FROM acc WINDOW r AS (PARTITION BY series ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""


@query("rolling_accuracy", "I8", round_sql(ROLLING_SQL, ["accuracy", "rolling_accuracy", "target"]))
def q_rolling_accuracy(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hist = forecast.accuracy_history(fixtures.daily_counts(t), days=ACCURACY_DAYS)
    return round_doubles(forecast.rolling_accuracy(hist))


# --- I4, I5: full history report and its summary ------------------------------

HIST_START = "1994-01-01"
PERF_SQL = f"""perf AS (
  SELECT series, week_end AS date, prediction AS predicted, total AS actual,
         LEAST(GREATEST(1.0 - abs(prediction - total) / total, 0.0), 1.0) AS accuracy,
         prediction - total AS error, (prediction - total) / total * 100.0 AS error_pct
  FROM (SELECT *, MAX(week_idx) OVER (PARTITION BY series) AS last_idx FROM f) z
  WHERE week_idx >= 52 AND week_idx < last_idx AND n_days = 7 AND total > 0 AND week_end >= DATE '{HIST_START}')"""
PERF_BASE = with_(X1, WEEKLY_SQL, f"f AS ({blend_sql('dense', 0.0)})", PERF_SQL)


@query("historical_performance", "I4", round_sql(PERF_BASE + "SELECT * FROM perf",
                                                 ["predicted", "actual", "accuracy", "error", "error_pct"]))
def q_historical_performance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(forecast.historical_performance(fixtures.daily_counts(t), start_date=HIST_START))


SUMMARY_SQL = PERF_BASE + """
SELECT series, COUNT(*) AS weeks, AVG(accuracy) AS mean_accuracy, sqrt(AVG(error * error)) / 7.0 AS rmse_daily,
       AVG(abs(error)) / 7.0 AS mae_daily, AVG(abs(error) / actual) * 100.0 AS mape_pct
FROM perf GROUP BY 1"""


@query("performance_summary", "I5", round_sql(SUMMARY_SQL, ["mean_accuracy", "rmse_daily", "mae_daily",
                                                            "mape_pct"]))
def q_performance_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    perf = forecast.historical_performance(fixtures.daily_counts(t), start_date=HIST_START)
    return round_doubles(forecast.performance_summary(perf))


# --- I7, I9: daily view and confidence band -----------------------------------


DAILY_VIEW_SQL = f"""SELECT series, week_end, prediction / 7.0 AS daily_prediction, actual / 7.0 AS daily_actual,
       lower_bound / 7.0 AS daily_lower_bound, upper_bound / 7.0 AS daily_upper_bound,
       uncertainty / 7.0 AS daily_uncertainty
FROM ({FORECAST_SQL}) q
QUALIFY ROW_NUMBER() OVER (PARTITION BY series ORDER BY week_end DESC) <= 12"""


@query("daily_view", "I7", round_sql(DAILY_VIEW_SQL, ["daily_prediction", "daily_actual", "daily_lower_bound",
                                                      "daily_upper_bound", "daily_uncertainty"], 2))
def q_daily_view(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(forecast.daily_view(forecast.weekly_forecast(fixtures.daily_counts(t)), last_n=12), 2)


BAND_SQL = f"""SELECT series, week_end, prediction AS predicted, confidence,
       prediction - prediction * (1.0 - confidence) * 0.1 AS band_lower,
       prediction + prediction * (1.0 - confidence) * 0.1 AS band_upper
FROM (SELECT *, 1.0 / (1.0 + uncertainty / prediction) AS confidence FROM ({FORECAST_SQL}) q0) q"""


@query("confidence_band", "I9", round_sql(BAND_SQL, ["predicted", "confidence", "band_lower", "band_upper"], 2))
def q_confidence_band(spark, sf_dir):
    t = Tables(spark, sf_dir)
    f = forecast.weekly_forecast(fixtures.daily_counts(t))
    f = f.select("series", "week_end", F.col("prediction").alias("predicted"),
                 (1.0 / (1.0 + F.col("uncertainty") / F.col("prediction"))).alias("confidence"))
    return round_doubles(forecast.confidence_band(f), 2)
