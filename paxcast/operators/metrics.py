"""Evaluation metrics as grouped aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def prediction_metrics(df: DataFrame, keys=("model",), actual: str = "actual", pred: str = "pred") -> DataFrame:
    """RMSE, MAE, R^2 (1 - SSE / SST, SST = var_pop * n) and MAPE per group."""
    err = F.col(pred) - F.col(actual)
    g = df.groupBy(*keys).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(actual) * F.count(actual)).alias("_sst"),
        (F.avg(F.abs(F.try_divide(err, F.col(actual)))) * 100.0).alias("mape"),
    )
    return g.select(*keys, "rmse", "mae", (1.0 - F.try_divide(F.col("_sse"), F.nullif(F.col("_sst"), F.lit(0.0))))
                    .alias("r2"), "mape")


def trading_metrics(df: DataFrame, key: str = "account", date: str = "date", ret: str = "ret",
                    position: str = "position", risk_free: float = 0.02) -> DataFrame:
    """Compounded total return, annual return, volatility, Sharpe (0 at
    zero volatility), max drawdown of the compounded curve, mean absolute
    position and position changes (the first row counts as a change). A return
    of -100% or worse ruins the account: its growth is 0 from there on."""
    w = Window.partitionBy(key).orderBy(date)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    alive = F.log1p(F.greatest(F.col(ret), F.lit(-0.999999999)))
    ruined = F.col(ret) <= -1
    growth = F.when(F.max(ruined).over(run), F.lit(0.0)).otherwise(F.exp(F.sum(alive).over(run)))
    x = df.withColumn("_g", growth)
    x = x.withColumn("_dd", F.col("_g") / F.max("_g").over(run) - 1.0)
    prev = F.lag(position).over(w)
    x = x.withColumn("_chg", F.when(prev.isNull() | (prev != F.col(position)), 1).otherwise(0))
    g = x.groupBy(key).agg(
        (F.when(F.max(ruined), F.lit(0.0)).otherwise(F.exp(F.sum(alive))) - 1.0).alias("total_return"),
        F.count(ret).alias("_n"),
        F.stddev_samp(ret).alias("_sd"),
        F.min("_dd").alias("max_drawdown"),
        F.avg(F.abs(F.col(position))).alias("avg_position"),
        F.sum("_chg").cast("bigint").alias("position_changes"),
    )
    annual = F.pow(1.0 + F.col("total_return"), F.lit(float(TRADING_DAYS)) / F.col("_n")) - 1.0
    vol = F.col("_sd") * math.sqrt(TRADING_DAYS)
    sharpe = F.when(vol != 0, (annual - risk_free) / vol).otherwise(F.lit(0.0))
    return g.select(key, "total_return", annual.alias("annual_return"), vol.alias("volatility"),
                    sharpe.alias("sharpe_ratio"), "max_drawdown", "avg_position", "position_changes")


def contract_metrics(df: DataFrame, keys=(), prob: str = "prob", outcome: str = "outcome",
                     price: str = "price") -> DataFrame:
    """Accuracy of the half-even rounded probability, mean edge,
    theoretical P&L of buying when prob > price, and edge Sharpe over the
    per-row edges."""
    edge = F.col(prob) - F.col(price)
    aggs = [
        F.avg((F.rint(F.col(prob)) == F.col(outcome)).cast("double")).alias("prediction_accuracy"),
        F.avg(edge).alias("average_edge"),
        F.sum(F.when(F.col(prob) > F.col(price), F.col(outcome) - F.col(price)).otherwise(F.lit(0.0)))
        .alias("theoretical_pnl"),
        F.stddev_samp(edge).alias("_sd"),
    ]
    g = df.groupBy(*keys).agg(*aggs)
    return g.select(*keys, "prediction_accuracy", "average_edge", "theoretical_pnl",
                    F.when(F.col("_sd") != 0, F.col("average_edge") / F.col("_sd")).otherwise(F.lit(0.0))
                    .alias("edge_sharpe"))


def accuracy_by_time(df: DataFrame, ts: str = "date", keys=(), actual: str = "actual", pred: str = "pred",
                     last_days: int | None = None) -> DataFrame:
    """Accuracy per timestamp (1 - |p - a| / a, clamped) and, with
    ``last_days``, the mean and std over the last N days of each key."""
    acc = F.least(F.greatest(1.0 - F.abs(F.col(pred) - F.col(actual)) / F.col(actual), F.lit(0.0)), F.lit(1.0))
    per_ts = df.groupBy(*keys, ts).agg(F.avg(acc).alias("accuracy"))
    if last_days is None:
        return per_ts
    if keys:
        x = per_ts.withColumn("_mx", F.max(ts).over(Window.partitionBy(*keys)))
    else:
        # One global latest date: a scalar subquery, not a one-partition window.
        x = per_ts.withColumn("_mx", per_ts.select(F.max(ts)).scalar())
    x = x.where(F.col(ts) > F.date_sub("_mx", last_days))
    return x.groupBy(*keys).agg(F.avg("accuracy").alias("mean_accuracy"),
                                F.stddev_samp("accuracy").alias("std_accuracy"))


def interval_coverage(df: DataFrame, keys=(), actual: str = "actual", lower: str = "lower_bound",
                      upper: str = "upper_bound", pred: str = "prediction", unc: str = "uncertainty") -> DataFrame:
    """Share of actuals inside [lower, upper], mean uncertainty and MSE."""
    inside = F.col(actual).between(F.col(lower), F.col(upper)).cast("double")
    err = F.col(pred) - F.col(actual)
    return df.groupBy(*keys).agg(F.avg(inside).alias("coverage"), F.avg(unc).alias("mean_uncertainty"),
                                 F.avg(err * err).alias("mse"))
