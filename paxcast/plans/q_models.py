"""Queries: model fits and forecasts.

Smoothing, seasonal autoregression, out-of-fold predictions and conformal bands
have SQL oracles, as have folds, hold-out split, equal weights and quantiles.
Trees and Huber weights have none; the tests hold them to known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from paxcast.functions.stats import probit_sql
from paxcast.operators import features, models
from paxcast.plans.oracle_views import X1, X8, X13, coefficient_sql, gram_sql, sweep_sql, with_
from paxcast.plans.registry import query, round_doubles, round_sql
from paxcast.sources import fixtures
from paxcast.sources.tables import Tables

GBT_FEATURES = ["day_of_week", "month", "is_weekend", "lag_1", "lag_7", "rolling_mean_7", "rolling_std_7"]


HORIZON = 7
Z95 = "CAST(1.959963984540054 AS DOUBLE)"


def _smoothing_sql() -> str:
    """The recursion one day per step, all grid points side by side."""
    m = models.SEASON
    axis = [f"(SELECT unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in values)}]) AS {name}, unnest(range({len(values)})) AS i{name})"
            for name, values in (("a", models.HW_ALPHAS), ("b", models.HW_BETAS), ("g", models.HW_GAMMAS), ("p", models.HW_PHIS))]
    sizes = [len(v) for v in (models.HW_ALPHAS, models.HW_BETAS, models.HW_GAMMAS, models.HW_PHIS)]
    place = f"((ia * {sizes[1]} + ib) * {sizes[2]} + ig) * {sizes[3]} + ip"
    return with_(X1, f"""grid AS (SELECT {place} AS i, a, b, g, p FROM {" CROSS JOIN ".join(axis)})""",
                 """days AS (SELECT series, date, passengers AS y, ROW_NUMBER() OVER (PARTITION BY series ORDER BY date) - 1 AS t FROM x1)""",
                 f"""starts AS (SELECT series, COUNT(*) AS n, MAX(date) AS last_date, AVG(y) FILTER (t < {m}) AS first_mean,
              AVG(y) FILTER (t >= {m} AND t < {2 * m}) AS second_mean, list(y ORDER BY t) FILTER (t < {m}) AS head FROM days GROUP BY 1)""",
                 f"""states AS (
  WITH RECURSIVE r AS (
    SELECT series, n, i, a, b, g, p, CAST({m} AS BIGINT) AS t, first_mean AS level, (second_mean - first_mean) / {m} AS trend,
           list_transform(head, lambda v: v - first_mean) AS season, 0.0::DOUBLE AS sse, 0.0::DOUBLE AS total
    FROM starts CROSS JOIN grid WHERE n > {2 * m}
    UNION ALL
    SELECT series, n, i, a, b, g, p, t + 1, up, b * (up - level) + (1 - b) * p * trend,
           list_concat(season[2:], [g * (y - level - p * trend) + (1 - g) * season[1]]), sse + err * err, total + err
    FROM (SELECT r.*, d.y, d.y - (level + p * trend + season[1]) AS err, a * (d.y - season[1]) + (1 - a) * (level + p * trend) AS up
          FROM r JOIN days d ON d.series = r.series AND d.t = r.t) q)
  SELECT * FROM r WHERE t = n)""",
                 "best AS (SELECT * FROM states QUALIFY ROW_NUMBER() OVER (PARTITION BY series ORDER BY sse, i) = 1)") + f"""
SELECT series, date, h, forecast, uncertainty, forecast - {Z95} * uncertainty AS lower_bound, forecast + {Z95} * uncertainty AS upper_bound,
       alpha, beta, gamma, phi, error
FROM (SELECT s.series, CAST(s.last_date + CAST(h.h AS INTEGER) AS DATE) AS date, h.h AS h,
       level + list_sum(list_transform(range(1, h.h + 1), lambda j: pow(p, j))) * trend + season[(h.h - 1) % {m} + 1] AS forecast,
       sqrt(greatest(sse / (s.n - {m}) - pow(total / (s.n - {m}), 2), 0.0)) * sqrt(h.h) AS uncertainty,
       a AS alpha, b AS beta, g AS gamma, p AS phi, CAST(NULL AS VARCHAR) AS error
      FROM best x JOIN starts s ON s.series = x.series CROSS JOIN (SELECT unnest(range(1, {HORIZON} + 1)) AS h) h
      UNION ALL
      SELECT series, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Insufficient historical data' FROM starts WHERE n <= {2 * m}) z"""


SMOOTHING_COLS = ["forecast", "uncertainty", "lower_bound", "upper_bound", "alpha", "beta", "gamma", "phi"]


@query("exp_smoothing_forecast", "J1", round_sql(_smoothing_sql(), SMOOTHING_COLS, 3))
def q_exp_smoothing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(models.exp_smoothing_forecast(fixtures.daily_counts(t), horizon=HORIZON), 3)


FOLDS_SQL = with_(X1) + f"""
SELECT series, date, fold, role FROM (
  SELECT x.series, x.date, f.fold,
         CASE WHEN i < n - ({models.N_SPLITS} - f.fold) * ts THEN 'train'
              WHEN i < n - ({models.N_SPLITS} - f.fold) * ts + ts THEN 'test' END AS role
  FROM (SELECT series, date, ROW_NUMBER() OVER (PARTITION BY series ORDER BY date) - 1 AS i,
               COUNT(*) OVER (PARTITION BY series) AS n,
               COUNT(*) OVER (PARTITION BY series) // {models.N_SPLITS + 1} AS ts
        FROM x1) x CROSS JOIN range({models.N_SPLITS}) f(fold)) z
WHERE role IS NOT NULL"""


@query("ts_folds", "J4", FOLDS_SQL)
def q_ts_folds(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(models.time_series_folds(fixtures.daily_counts(t)))


HOLDOUT_SQL = with_(X1) + f"""
SELECT series, date, passengers,
       CASE WHEN date > MAX(date) OVER (PARTITION BY series) - {models.HOLDOUT_DAYS} THEN 'validate' ELSE 'train' END
         AS role
FROM x1"""


@query("holdout_split", "J7", round_sql(HOLDOUT_SQL, ["passengers"]))
def q_holdout(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(models.holdout_split(fixtures.daily_counts(t)))


ENSEMBLE_SQL = with_(X8) + """
SELECT series, date, AVG(pred) AS prediction, STDDEV_POP(pred) AS uncertainty, COUNT(pred) AS models,
       1.0 / (1.0 + STDDEV_POP(pred)) AS confidence
FROM x8 GROUP BY 1, 2"""


@query("ensemble_equal_weights", "J8", round_sql(ENSEMBLE_SQL, ["prediction", "uncertainty", "confidence"], 2))
def q_ensemble_equal(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = fixtures.model_predictions(t)
    return round_doubles(models.ensemble_predict(p, models.equal_weights(p)), 2)


@query("ensemble_huber", "J6 J8")
def q_ensemble_huber(spark, sf_dir):
    t = Tables(spark, sf_dir)
    split = models.holdout_split(fixtures.model_predictions(t))
    weights = models.huber_weights(split.where("role = 'train'"))
    return round_doubles(models.ensemble_predict(split.where("role = 'validate'"), weights), 2)


FEATURES_SQL = X1 + """,
lagged AS (
  SELECT series, date, passengers AS actual, LAG(passengers, 1) OVER w AS lag_1, LAG(passengers, 7) OVER w AS lag_7, LAG(passengers, 14) OVER w AS lag_14,
         CASE WHEN COUNT(passengers) OVER w28 = 28 THEN AVG(passengers) OVER w28 END AS mean_28,
         CAST(date - DATE '2000-01-01' AS DOUBLE) AS day_no,
         """ + ",\n         ".join(f"CASE WHEN isodow(date) - 1 = {d} THEN 1.0 ELSE 0.0 END AS dow_{d}" for d in range(1, 7)) + """
  FROM x1
  WINDOW w AS (PARTITION BY series ORDER BY date), w28 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
complete AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY date) - 1 AS i, COUNT(*) OVER (PARTITION BY series) AS n
  FROM lagged WHERE lag_14 IS NOT NULL AND mean_28 IS NOT NULL)"""


def _out_of_fold_sql() -> str:
    """Each fold fitted by itself on all rows before it."""
    k = models.N_SPLITS
    columns = sorted({c for f in models.BASE_MODELS.values() for c in f}) + ["actual"]
    m = len(columns) + 1
    ctes = [FEATURES_SQL, f"""blocks AS (
  SELECT *, CAST(CASE WHEN n // {k + 1} > 0 THEN greatest(floor((i - (n - {k} * (n // {k + 1}))) / (n // {k + 1})) + 1, 0) ELSE 0 END AS INTEGER) AS block FROM complete)""",
            f"seen AS (SELECT b.*, CAST(f.fold AS INTEGER) AS fold FROM blocks b JOIN (SELECT unnest(range(1, {k + 1})) AS fold) f ON b.block < f.fold)",
            "grams AS (" + gram_sql("seen", "series, fold", columns) + ")"]
    parts = []
    for name, features in models.BASE_MODELS.items():
        places = [0, *(columns.index(c) + 1 for c in features)]
        ctes.append(sweep_sql(f"s_{name}", "grams", "series, fold", m, str(places)))
        terms = " + ".join([coefficient_sql(0, m - 1, m), *(f"{coefficient_sql(p, m - 1, m)} * x.{c}" for p, c in zip(places[1:], features, strict=True))])
        parts.append(f"SELECT x.series, x.date, x.block AS fold, '{name}' AS model, {terms} AS pred, x.actual "
                     f"FROM blocks x JOIN s_{name} f ON f.series = x.series AND f.fold = x.block")
    return with_(*ctes) + "\nUNION ALL\n".join(parts)


@query("out_of_fold_predictions", "J6 J7", round_sql(_out_of_fold_sql(), ["pred", "actual"], 2))
def q_out_of_fold(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(models.out_of_fold_predictions(models.base_features(fixtures.daily_counts(t))), 2)


@query("ensemble_stacked", "J6 J7 J8")
def q_ensemble_stacked(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(models.stacked_forecast(fixtures.daily_counts(t)), 2)


CALIBRATION_DAYS = 365
CONFORMAL_SQL = with_(X8, f"""m AS (
  SELECT series, date, actual, pred, actual - pred AS residual, MAX(date) OVER (PARTITION BY series) AS last_date FROM x8 WHERE model = 'mean28')""",
                      f"""cal AS (
  SELECT series, COUNT(*) AS n, list_sort(list(residual)) AS r FROM m
  WHERE date <= last_date - {models.HOLDOUT_DAYS} AND date > last_date - {models.HOLDOUT_DAYS + CALIBRATION_DAYS} GROUP BY 1)""",
                      """bounds AS (
  SELECT series, r[CAST(greatest(floor((n + 1) * 0.025 + 1e-9), 1) AS BIGINT)] AS low, r[CAST(least(ceil((n + 1) * 0.975 - 1e-9), n) AS BIGINT)] AS high
  FROM cal)""") + f"""
SELECT m.series, m.date, m.actual, m.pred AS prediction, m.pred + low AS lower_bound, m.pred + high AS upper_bound,
       ((m.pred + high) - (m.pred + low)) / 4.0 AS uncertainty
FROM m JOIN bounds b ON b.series = m.series WHERE m.date > m.last_date - {models.HOLDOUT_DAYS}"""


@query("conformal_bands", "J3", round_sql(CONFORMAL_SQL, ["actual", "prediction", "lower_bound", "upper_bound", "uncertainty"], 2))
def q_conformal_bands(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = fixtures.model_predictions(t).where("model = 'mean28'").select("series", "date", "actual", F.col("pred").alias("prediction"))
    split = models.holdout_split(p)
    earlier = models.holdout_split(split.where("role = 'train'").drop("role"), days=CALIBRATION_DAYS)
    held_out = earlier.where("role = 'validate'").select("series", (F.col("actual") - F.col("prediction")).alias("residual"))
    return round_doubles(models.conformal_bands(held_out, split.where("role = 'validate'").drop("role"), min_residuals=1), 2)


def _gbt(t: Tables):
    tm = features.training_matrix(fixtures.daily_counts(t))
    split = models.holdout_split(tm)
    train = split.where(F.col("role") == "train").drop("role")
    score = split.where(F.col("role") == "validate").drop("role")
    return models.gbt_forecast(train, score, GBT_FEATURES)


@query("gbt_forecast", "J2 J3")
def q_gbt_forecast(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out, _ = _gbt(t)
    return round_doubles(out.select("series", "date", "target", "prediction", "lower_bound", "upper_bound",
                                    "uncertainty"), 2)


@query("feature_importance", "J11")
def q_feature_importance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    _, model = _gbt(t)
    return round_doubles(models.feature_importance(model, GBT_FEATURES))


LAGS = (1, 7, 8)
AR_SQL = with_(X1, """diffs AS (SELECT series, date, passengers AS v, passengers - LAG(passengers) OVER (PARTITION BY series ORDER BY date) AS d FROM x1)""",
               "lagged AS (SELECT *, " + ", ".join(f"LAG(d, {k}) OVER w AS d{k}" for k in range(1, 9))
               + " FROM diffs WINDOW w AS (PARTITION BY series ORDER BY date))",
               "used AS (SELECT * FROM lagged WHERE d8 IS NOT NULL)",
               "grams AS (" + gram_sql("used", "series", ["d1", "d7", "d8", "d"], ", max(date) AS last_date, arg_max(v, date) AS v, arg_max([d, d1, d2, d3, d4, d5, d6, d7], date) AS recent") + ")",
               sweep_sql("sw", "grams", "series", 5, "[0, 1, 2, 3]"),
               f"""eq AS (
  SELECT g.series, last_date, v, recent, n_rows, {", ".join(f"{coefficient_sql(p, 4, 5)} AS b{p}" for p in range(4))},
         greatest(s[25], 0.0) AS sse, {" + ".join(f"(s[{p * 5 + p + 1}] < 0)::INT" for p in range(4))} AS rnk
  FROM grams g JOIN sw ON sw.series = g.series)""",
               f"""roll AS (
  WITH RECURSIVE r AS (
    SELECT series, 0 AS h, v AS level, recent, [1.0::DOUBLE] AS psi, 0.0::DOUBLE AS lift, 0.0::DOUBLE AS total, b0, b1, b2, b3, last_date, sqrt(sse / (n_rows - rnk)) AS sd
    FROM eq WHERE n_rows > rnk
    UNION ALL
    SELECT series, h + 1, level + nd, list_concat([nd], recent[1:7]), CASE WHEN h = 0 THEN psi ELSE list_concat([np], psi) END,
           lift + CASE WHEN h = 0 THEN 1.0 ELSE np END, total + pow(lift + CASE WHEN h = 0 THEN 1.0 ELSE np END, 2), b0, b1, b2, b3, last_date, sd
    FROM (SELECT *, b0 + b1 * recent[1] + b2 * recent[7] + b3 * recent[8] AS nd,
                 b1 * psi[1] + b2 * coalesce(psi[7], 0.0) + b3 * coalesce(psi[8], 0.0) AS np FROM r) q WHERE h < {HORIZON})
  SELECT * FROM r WHERE h > 0)""") + f"""
SELECT series, CAST(last_date + CAST(h AS INTEGER) AS DATE) AS date, CAST(h AS BIGINT) AS h, level AS prediction,
       level - {Z95} * sd * sqrt(total) AS lower_bound, level + {Z95} * sd * sqrt(total) AS upper_bound, sd * sqrt(total) AS uncertainty
FROM roll"""


@query("seasonal_ar_forecast", "J5", round_sql(AR_SQL, ["prediction", "lower_bound", "upper_bound", "uncertainty"], 2))
def q_seasonal_ar(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(models.seasonal_ar_forecast(fixtures.daily_counts(t), lags=LAGS, horizon=HORIZON), 2)


QUANTILE_SQL = with_(X13) + f"""
SELECT event_id, prob, {probit_sql('prob')} AS prob_quantile FROM x13"""


@query("normal_quantiles", "J13", round_sql(QUANTILE_SQL, ["prob", "prob_quantile"], 6))
def q_normal_quantiles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    b = fixtures.binary_forecasts(t).select("event_id", "prob")
    return round_doubles(models.normal_quantile(b, "prob"), 6)
