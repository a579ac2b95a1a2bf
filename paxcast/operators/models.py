"""Forecasting models on Spark.

* J1 damped Holt-Winters: one row per series holds its days as an array; the
  recursion is a fold over that array for every point of the parameter grid,
  inside built-in expressions. An array is one series' daily history, bounded by
  the calendar, not by the raw row count (raw rows are aggregated to days first).
* J5 and the base models of J6/J7 are least squares from one grouped
  cross-product matrix each (:mod:`paxcast.operators.regression`); J5 rolls its
  equation out over the days after the last one.
* J3 bands are split-conformal: residuals of rows the model never saw, kept in
  mergeable quantile sketches per series.
* J6/J7: out-of-fold predictions are a table; weights are learnt on it.
* J2 and the Huber weights use Spark ML estimators (distributed fits).
* J4, J7, J8 are DataFrame expressions.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paxcast.functions.stats import probit
from paxcast.operators import regression

# Smoothing grid (level, trend, season, damping) and period.
HW_ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)
HW_BETAS = (0.01, 0.1, 0.3)
HW_GAMMAS = (0.05, 0.2, 0.5)
HW_PHIS = (0.8, 0.9, 0.98)
SEASON = 7
HOLDOUT_DAYS = 30
N_SPLITS = 5
HUBER_EPSILON = 1.35
#: Residuals a quantile sketch keeps before it starts to thin them out.
SKETCH_K = 2000
#: Held-out residuals a series needs for a band of its own.
MIN_RESIDUALS = 40


def _smoothing_grid() -> str:
    """SQL text: the parameter grid as an array of structs."""
    points = [(a, b, g, p) for a in HW_ALPHAS for b in HW_BETAS for g in HW_GAMMAS for p in HW_PHIS]
    return "array(" + ", ".join(f"named_struct('a', {a}D, 'b', {b}D, 'g', {g}D, 'p', {p}D)" for a, b, g, p in points) + ")"


def _smoothing_fold(m: int) -> str:
    """SQL text: the state of the recursion after the days from ``m`` on, for a grid
    point ``q``; the season array is turned by one place a day, so that its
    head is always the day's own season."""
    start = (f"named_struct('level', _first, 'trend', (_second - _first) / {m}, 'season', transform(slice(y, 1, {m}), v -> v - _first), "
             "'sse', 0D, 'sum', 0D)")
    err = "(v - (s.level + q.p * s.trend + s.season[0]))"
    level = "(q.a * (v - s.season[0]) + (1 - q.a) * (s.level + q.p * s.trend))"
    return f"""aggregate(slice(y, {m + 1}, size(y)), {start}, (s, v) -> named_struct(
      'level', {level},
      'trend', q.b * ({level} - s.level) + (1 - q.b) * q.p * s.trend,
      'season', concat(slice(s.season, 2, {m - 1}), array(q.g * (v - s.level - q.p * s.trend) + (1 - q.g) * s.season[0])),
      'sse', s.sse + {err} * {err},
      'sum', s.sum + {err}))"""


def exp_smoothing_forecast(daily: DataFrame, key: str = "series", date: str = "date", value: str = "passengers",
                           horizon: int = 7, conf_level: float = 0.95) -> DataFrame:
    """Per-series damped Holt-Winters forecast for ``horizon`` days with
    uncertainty ``resid_std * sqrt(h)`` and a normal interval, by the grid point of
    the least one-step squared error (the first of equal ones). A series too
    short for two seasons is one row of null figures with an error text; days
    without a value are left out."""
    from statistics import NormalDist

    z, m = NormalDist().inv_cdf((1 + conf_level) / 2), SEASON
    series = daily.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("v")))).alias("_days"))
    series = series.select(key, F.expr("element_at(_days, -1).d").alias("_last"), F.expr("transform(_days, x -> x.v)").alias("y"))
    mean = "aggregate(slice(y, {at}, {m}), 0D, (s, v) -> s + v) / {m}"
    series = series.withColumn("_first", F.expr(mean.format(at=1, m=m))).withColumn("_second", F.expr(mean.format(at=m + 1, m=m)))
    # The fitted state of every grid point; the struct's order makes the least error the least struct.
    fitted = f"""transform({_smoothing_grid()}, (q, i) -> named_struct('q', q, 'i', i, 's', {_smoothing_fold(m)}))"""
    ranked = f"transform({fitted}, x -> named_struct('sse', x.s.sse, 'i', x.i, 'q', x.q, 's', x.s))"
    series = series.withColumn("_best", F.when(F.size("y") > 2 * m, F.expr(f"array_min({ranked})")))
    sd = "sqrt(greatest(_best.sse / (size(y) - 7) - pow(_best.s.sum / (size(y) - 7), 2), 0D))".replace("7", str(m))
    series = series.withColumn("_sd", F.expr(sd))
    damp = "aggregate(sequence(1, h), 0D, (s, j) -> s + pow(_best.q.p, j))"
    days = series.withColumn("h", F.expr(f"explode(if(_best is null, array(cast(null as int)), sequence(1, {int(horizon)})))"))
    days = days.withColumn("forecast", F.expr(f"_best.s.level + {damp} * _best.s.trend + _best.s.season[(h - 1) % {m}]"))
    days = days.withColumn("uncertainty", F.expr("_sd * sqrt(h)"))
    return days.select(
        key, F.expr("date_add(_last, h)").alias("date"), "h", "forecast", "uncertainty",
        (F.col("forecast") - z * F.col("uncertainty")).alias("lower_bound"), (F.col("forecast") + z * F.col("uncertainty")).alias("upper_bound"),
        *(F.col(f"_best.q.{c}").alias(name) for c, name in (("a", "alpha"), ("b", "beta"), ("g", "gamma"), ("p", "phi"))),
        F.when(F.col("_best").isNull(), "Insufficient historical data").alias("error"))


def time_series_folds(df: DataFrame, key: str = "series", date: str = "date", n_splits: int = N_SPLITS) -> DataFrame:
    """Expanding-window folds per key (test size ``n // (n_splits + 1)``,
    the last ``n_splits`` blocks are the tests): rows ``(key, date, fold, role)``."""
    w = Window.partitionBy(key).orderBy(date)
    x = df.select(key, date, (F.row_number().over(w) - 1).alias("_i"),
                  F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n"))
    x = x.withColumn("_ts", (F.col("_n") / (n_splits + 1)).cast("int"))
    x = x.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("_n") - (n_splits - F.col("fold")) * F.col("_ts")
    role = F.when(F.col("_i") < start, F.lit("train")).when(F.col("_i") < start + F.col("_ts"), F.lit("test"))
    return x.select(key, date, "fold", role.alias("role")).where(F.col("role").isNotNull())


def holdout_split(df: DataFrame, key: str = "series", date: str = "date", days: int = HOLDOUT_DAYS) -> DataFrame:
    """``role`` = validate for the last ``days`` days of each key, train
    strictly before the cutoff."""
    cutoff = F.date_sub(F.max(date).over(Window.partitionBy(key)), days)
    return df.withColumn("role", F.when(F.col(date) > cutoff, F.lit("validate")).otherwise(F.lit("train")))


def ensemble_predict(preds: DataFrame, weights: DataFrame, keys=("series", "date"), model: str = "model",
                     pred: str = "pred") -> DataFrame:
    """Weighted mean of the model predictions present at the key (the
    weights of missing models are shared out); uncertainty is the population
    std across models (unweighted), confidence ``1 / (1 + uncertainty)``."""
    j = preds.join(weights, model)
    present = F.sum(F.when(F.col(pred).isNotNull(), F.col("weight")))
    mean = F.try_divide(F.sum(F.col("weight") * F.col(pred)), present)
    g = j.groupBy(*keys).agg(mean.alias("prediction"),
                             F.stddev_pop(pred).alias("uncertainty"), F.count(pred).alias("models"))
    return g.withColumn("confidence", 1.0 / (1.0 + F.col("uncertainty")))


def equal_weights(preds: DataFrame, model: str = "model") -> DataFrame:
    """Equal weights over the models present (the fallback of J6)."""
    m = preds.select(model).distinct()
    return m.withColumn("weight", 1.0 / m.select(F.count(F.lit(1))).scalar())


def huber_weights(preds: DataFrame, keys=("series", "date"), model: str = "model", pred: str = "pred",
                  actual: str = "actual", epsilon: float = HUBER_EPSILON) -> DataFrame:
    """Huber regression of the actual on the model predictions (no
    intercept); negative weights become 0 and the rest are normalised to 1,
    equal weights when nothing is left. The fit aggregates over all rows;
    only the per-model weights (one number each) return to the driver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = sorted(r[0] for r in preds.select(model).distinct().collect())
    wide = preds.groupBy(*keys).agg(
        *(F.max(F.when(F.col(model) == n, F.col(pred))).alias(n) for n in names), F.first(actual).alias(actual)).dropna()
    va = VectorAssembler(inputCols=names, outputCol="features")
    lr = LinearRegression(loss="huber", epsilon=epsilon, fitIntercept=False, labelCol=actual, regParam=0.0)
    fit = lr.fit(va.transform(wide))
    w = [max(0.0, float(c)) for c in fit.coefficients]
    total = sum(w)
    w = [x / total for x in w] if total > 0 else [1.0 / len(names)] * len(names)
    return preds.sparkSession.createDataFrame(list(zip(names, w)), f"{model} string, weight double")


def conformal_bands(held_out: DataFrame, scored: DataFrame, key: str = "series", residual: str = "residual",
                    prediction: str = "prediction", conf_level: float = 0.95, k: int = SKETCH_K,
                    min_residuals: int = MIN_RESIDUALS) -> DataFrame:
    """Bands by split-conformal calibration.

    ``held_out``: (key, residual) of rows that the model was not fitted on. Their
    quantiles come from a mergeable sketch per series; of n residuals the ranks
    ceil((n + 1) * q) and its mirror bound a new one with at least the nominal chance
    (:func:`_sketch_bounds`).
    A series of fewer than ``min_residuals`` takes the sketch merged over all.
    Uncertainty is ``(upper - lower) / 4``; a sketch of up to ``k`` residuals is exact.
    """
    tail = (1 - conf_level) / 2
    own = held_out.where(F.col(residual).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.expr(f"kll_sketch_agg_double(cast(`{residual}` as double), {int(k)})").alias("_sketch"))
    pooled = own.agg(F.sum("_n").alias("_n"), F.expr("kll_merge_agg_double(_sketch)").alias("_sketch")).where("_n > 0")
    own, pooled = _sketch_bounds(own, tail), _sketch_bounds(pooled, tail)
    x = scored.join(own.where(F.col("_n") >= min_residuals), F.col(key) == F.col("_key"), "left")
    low, high = (F.col(prediction) + F.coalesce(c, pooled.select(c).scalar()) for c in ("_low", "_high"))
    return x.select(*scored.columns, low.alias("lower_bound"), high.alias("upper_bound"), ((high - low) / 4.0).alias("uncertainty"))


def _sketch_bounds(sketches: DataFrame, tail: float, steps: int = 512) -> DataFrame:
    """``_low`` and ``_high`` of each sketch of ``_n`` residuals: the items of rank
    floor((n + 1) * tail) and ceil((n + 1) * (1 - tail)). Ranks asked of a sketch are
    constants, so the nearest of ``steps`` even ones in the tail is picked; up to
    n = steps / tail / 2 that is the very item."""
    step = tail / steps

    def item(count: str, first: float, sign: int):
        ranks = "array(" + ", ".join(f"{min(max(first + sign * j * step, 0.0), 1.0)!r}D" for j in range(steps + 1)) + ")"
        # Half a rank inside the item asked for, so that rounding can't miss it.
        j = f"cast(least(greatest(ceil(({sign}D) * (({count} - 0.5D) / _n - {first!r}D) / {step!r}D), 0), {steps}) as int)"
        return F.expr(f"kll_sketch_get_quantile_double(_sketch, {ranks})[{j}]")

    low = item(f"greatest(floor((_n + 1) * {tail!r}D + 1e-9D), 1)", tail, -1)
    high = item(f"least(ceil((_n + 1) * {1 - tail!r}D - 1e-9D), _n)", 1 - tail, 1)
    return sketches.withColumn("_low", low).withColumn("_high", high).drop("_sketch")


def gbt_forecast(train: DataFrame, score: DataFrame, features, label: str = "target", key: str = "series",
                 date: str = "date", calibration_days: int = 90, conf_level: float = 0.95, seed: int = 7, max_iter: int = 30):
    """J2 + J3 + J11: scaled features -> gradient-boosted trees. The last
    ``calibration_days`` of ``train`` are kept from the fit; their residuals give the
    bands (:func:`conformal_bands`). Returns the scored table and the fitted
    pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, seed=seed),
    ])
    split = holdout_split(train, key, date, calibration_days)
    model = pipe.fit(split.where("role = 'train'").drop("role"))
    kept = model.transform(split.where("role = 'validate'").drop("role"))
    scored = model.transform(score).select(*score.columns, "prediction")
    return conformal_bands(kept.select(key, (F.col(label) - F.col("prediction")).alias("residual")), scored, key, conf_level=conf_level), model


def feature_importance(model, features, top_n: int | None = None):
    """(feature, importance) rows of a fitted tree pipeline, largest first."""
    tree = model.stages[-1]
    rows = sorted(zip(features, (float(v) for v in tree.featureImportances.toArray())), key=lambda r: -r[1])
    rows = rows[:top_n] if top_n else rows
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def seasonal_ar_fit(daily: DataFrame, key: str = "series", date: str = "date", value: str = "passengers",
                    lags=(1, 7, 8), exog=()) -> DataFrame:
    """J5, the fit: per series the least-squares equation of the first difference on a
    constant, its ``lags`` and the ``exog`` columns. One row per series: ``rows``,
    ``beta`` (constant, lags, exog), ``sse``, ``rank``, and where the series stands:
    ``last_date``, ``last_value``, ``recent`` (the last differences, newest first)."""
    w = Window.partitionBy(key).orderBy(date)
    deepest = max(lags)
    x = daily.where(F.col(value).isNotNull()).select(key, date, F.col(value).cast("double").alias("_v"), *exog)
    x = x.withColumn("_d", F.col("_v") - F.lag("_v").over(w))
    x = x.select("*", *(F.lag("_d", k).over(w).alias(f"_d{k}") for k in range(1, deepest + 1)))
    recent = F.array("_d", *(F.col(f"_d{k}") for k in range(1, deepest)))
    state = F.max_by(F.struct(F.col(date).alias("last_date"), F.col("_v").alias("last_value"), recent.alias("recent")), date).alias("_state")
    features = [f"_d{k}" for k in lags] + list(exog)
    used = x.dropna(subset=["_d", *(f"_d{k}" for k in range(1, deepest + 1)), *exog])
    out = regression.fit(used, [key], features, "_d", state)
    return out.select(key, "rows", "beta", "sse", "rank", "_state.last_date", "_state.last_value", "_state.recent")


def seasonal_ar_forecast(daily: DataFrame, key: str = "series", date: str = "date", value: str = "passengers",
                         lags=(1, 7, 8), exog=(), future: DataFrame | None = None, horizon: int = 7,
                         conf_level: float = 0.95) -> DataFrame:
    """The ``horizon`` days after each series' last one, by rolling its own equation
    out: each predicted difference feeds the next. The variance of step h is the
    residual variance times the sum of squares of the level's psi weights, the
    partial sums of the recursion's answer to one shock. ``future`` holds (key, date,
    exog columns) of the days ahead, if the equation has exogenous columns; a day
    missing there counts as zeros. Series too short for the equation give no row."""
    from statistics import NormalDist

    z, n, deepest = NormalDist().inv_cdf((1 + conf_level) / 2), len(lags), max(lags)
    fits = seasonal_ar_fit(daily, key, date, value, lags, exog).where("rows > rank")
    fits = fits.withColumn("_sd", F.expr("sqrt(sse / (rows - rank))"))
    if exog:
        steps = future.select(F.col(key).alias("_k"), F.col(date).alias("_on"), F.array(*(F.col(c).cast("double") for c in exog)).alias("_x"))
        ahead = fits.select(key, "last_date", "beta").join(steps, F.col(key) == F.col("_k"))
        ahead = ahead.withColumn("_h", F.datediff("_on", "last_date")).where((F.col("_h") >= 1) & (F.col("_h") <= horizon))
        term = f"aggregate(zip_with(slice(beta, {n + 2}, {len(exog)}), _x, (b, x) -> b * x), 0D, (s, v) -> s + v)"
        ahead = ahead.groupBy(F.col(key).alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("_h", F.expr(term).alias("_t")))).alias("_ahead"))
        fits = fits.join(ahead, F.col(key) == F.col("_k"), "left").drop("_k")
        outside = "coalesce(_ahead[h], 0D)"
    else:
        outside = "0D"
    terms = " + ".join(f"beta[{i + 1}] * s.recent[{lag - 1}]" for i, lag in enumerate(lags))
    answer = " + ".join(f"beta[{i + 1}] * coalesce(get(s.psi, {lag - 1}), 0D)" for i, lag in enumerate(lags))
    path = f"""aggregate(sequence(1, {int(horizon)}), named_struct('recent', recent, 'level', last_value, 'out', cast(array() as array<double>)),
      (s, h) -> named_struct('recent', concat(array(beta[0] + {terms} + {outside}), slice(s.recent, 1, {deepest - 1})),
        'level', s.level + beta[0] + {terms} + {outside},
        'out', concat(s.out, array(s.level + beta[0] + {terms} + {outside})))).out"""
    # psi: answers of the difference to one shock, newest first; level: their running sum; total: its squares'.
    spread = f"""aggregate(sequence(2, {max(2, int(horizon))}), named_struct('psi', array(1D), 'level', 1D, 'total', 1D, 'out', array(1D)),
      (s, h) -> named_struct('psi', concat(array({answer}), s.psi), 'level', s.level + {answer},
        'total', s.total + pow(s.level + {answer}, 2), 'out', concat(s.out, array(s.total + pow(s.level + {answer}, 2))))).out"""
    x = fits.select(key, "last_date", "_sd", F.expr(path).alias("_path"), F.expr(spread).alias("_spread"))
    x = x.select(key, "last_date", "_sd", "_spread", F.posexplode("_path").alias("_i", "prediction"))
    x = x.withColumn("uncertainty", F.col("_sd") * F.sqrt(F.expr("_spread[_i]")))
    return x.select(
        key, F.expr("date_add(last_date, _i + 1)").alias("date"), (F.col("_i") + 1).alias("h"), "prediction",
        (F.col("prediction") - z * F.col("uncertainty")).alias("lower_bound"),
        (F.col("prediction") + z * F.col("uncertainty")).alias("upper_bound"), "uncertainty")


# Base models of the stack: feature columns of each (base_features makes them).
BASE_MODELS = {
    "autoregressive": ["lag_1", "lag_7", "lag_14"],
    "calendar": ["day_no", "dow_1", "dow_2", "dow_3", "dow_4", "dow_5", "dow_6"],
    "recent_mean": ["mean_28"],
}


def base_features(daily: DataFrame, key: str = "series", date: str = "date", value: str = "passengers",
                  ahead: bool = False) -> DataFrame:
    """Columns of the base models for every day, from earlier days only. ``ahead``
    adds the day after each series' last one, without a value."""
    x = daily.where(F.col(value).isNotNull()).select(key, date, F.col(value).cast("double").alias("actual"))
    if ahead:
        x = x.unionByName(x.groupBy(key).agg(F.date_add(F.max(date), 1).alias(date), F.lit(None).cast("double").alias("actual")))
    w = Window.partitionBy(key).orderBy(date)
    past = w.rowsBetween(-28, -1)
    x = x.select("*", *(F.lag("actual", k).over(w).alias(f"lag_{k}") for k in (1, 7, 14)),
                 F.when(F.count("actual").over(past) == 28, F.avg("actual").over(past)).alias("mean_28"))
    origin = F.lit("2000-01-01").cast("date")  # keeps day numbers small; any origin fits alike
    return x.withColumn("day_no", F.datediff(F.col(date), origin).cast("double")).select(
        "*", *(F.when(F.weekday(date) == d, 1.0).otherwise(0.0).alias(f"dow_{d}") for d in range(1, 7))).dropna(
        subset=["lag_1", "lag_7", "lag_14", "mean_28"])


def _long_predictions(x: DataFrame, keys: list[str], models: dict, last: bool) -> DataFrame:
    """(keys, date, actual, model, pred) of rows that carry a coefficient array per model."""
    pairs = [F.struct(F.lit(name).alias("model"), regression.dot(f"_beta_{name}", features).alias("pred")) for name, features in models.items()]
    return x.select(*keys, *([] if last else ["actual"]), F.explode(F.array(*pairs)).alias("_p")).select(
        *keys, *([] if last else ["actual"]), "_p.model", "_p.pred").where(F.col("pred").isNotNull())


def out_of_fold_predictions(features: DataFrame, key: str = "series", date: str = "date", n_splits: int = N_SPLITS,
                            models: dict | None = None) -> DataFrame:
    """Predictions of every base model for the rows of the expanding folds, by fits
    on the rows before the fold: ``(key, date, fold, model, pred, actual)``.

    The cross-product matrices of the blocks between fold borders are additive, so
    one aggregate and a running sum over at most ``n_splits + 1`` blocks a series
    give the fits of all folds; no row is scored by a fit that saw it."""
    models = models or BASE_MODELS
    x = features.where(F.col("actual").isNotNull())
    w = Window.partitionBy(key)
    place = F.row_number().over(w.orderBy(date)) - 1
    x = x.withColumn("_i", place).withColumn("_n", F.count(F.lit(1)).over(w))
    size = (F.col("_n") / (n_splits + 1)).cast("int")
    block = F.when(size > 0, F.greatest(F.floor((F.col("_i") - (F.col("_n") - n_splits * size)) / size) + 1, F.lit(0))).otherwise(0)
    x = x.withColumn("fold", block.cast("int"))  # 0: rows that only train; b: test rows of fold b
    columns = sorted({c for f in models.values() for c in f}) + ["actual"]
    m = len(columns) + 1
    blocks = regression.gram(x, [key, "fold"], columns)
    before = Window.partitionBy(key).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.select(key, "fold", F.array(*(F.sum(F.col("g")[i]).over(before) for i in range(m * m))).alias("g")).where("fold > 0 and g[0] is not null")
    fits = _model_fits(sums, [key, "fold"], models, columns)
    scored = x.where("fold > 0").join(fits, [key, "fold"])
    return _long_predictions(scored, [key, date, "fold"], models, False)


def _model_fits(grams: DataFrame, keys: list[str], models: dict, columns: list[str]) -> DataFrame:
    """Coefficients of every model per key, from one matrix of all their columns."""
    m = len(columns) + 1
    out = grams
    for name, features in models.items():
        pivots = [0, *(columns.index(c) + 1 for c in features)]
        out = out.withColumn("_pivots", F.array(*(F.lit(p) for p in pivots))).withColumn("_s", regression.swept("g", "_pivots", m))
        out = out.withColumn(f"_beta_{name}", F.expr(f"transform(_pivots, p -> {regression.coefficient('_s', 'p', str(m - 1), m)})")).drop("_s")
    return out.select(*keys, *(f"_beta_{name}" for name in models))


def stacked_forecast(daily: DataFrame, weights: DataFrame | None = None, key: str = "series", date: str = "date",
                     value: str = "passengers", models: dict | None = None) -> DataFrame:
    """The ensemble's forecast for the day after each series' last one. Weights
    are learnt by Huber regression on the out-of-fold predictions (unless given), the
    base models then fitted again on all rows."""
    models = models or BASE_MODELS
    features = base_features(daily, key, date, value, ahead=True)
    if weights is None:
        weights = huber_weights(out_of_fold_predictions(features, key, date, models=models), keys=(key, date))
    columns = sorted({c for f in models.values() for c in f}) + ["actual"]
    known = features.where(F.col("actual").isNotNull())
    fits = _model_fits(regression.gram(known, [key], columns), [key], models, columns)
    ahead = features.where(F.col("actual").isNull()).join(fits, key)
    return ensemble_predict(_long_predictions(ahead, [key, date], models, True), weights, keys=(key, date))


def normal_quantile(df: DataFrame, p: str) -> DataFrame:
    """The standard normal quantile of a probability column."""
    return df.withColumn(f"{p}_quantile", probit(p))


def save_model(model, root: str, name: str) -> str:
    """Write a fitted pipeline under ``<root>/<name>/<ts>``; ``root`` is a
    folder that every later reader reaches."""
    import datetime as dt

    path = os.path.join(root, name, dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S_%f"))
    model.write().overwrite().save(path)
    return path


def load_latest_model(spark, root: str, name: str):
    """Load the newest saved version of ``name`` (error when none)."""
    from pyspark.ml import PipelineModel

    base = os.path.join(root, name)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(base)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(s.getPath().getName() for s in fs.listStatus(hpath) if s.isDirectory()) if fs.exists(hpath) else []
    if not versions:
        raise FileNotFoundError(f"No saved versions of {name}")
    return PipelineModel.load(os.path.join(base, versions[-1]))
