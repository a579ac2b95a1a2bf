"""Risk: limit-aware sizing, ordered limit checks, risk metrics, the risk
report, market-condition scaling and utilisation (M1-M5, M7).

Account-level figures (exposure, capital, last P&L) are aggregated once per
account (partial aggregation before the shuffle) and joined to the per-row
table; the per-row rules are plain column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Risk limits and risk-manager defaults.
MAX_POSITION_SIZE = 1000
MAX_DAILY_LOSS = 0.15
MAX_LEVERAGE = 1.0
POSITION_LIMIT = 1000
CONCENTRATION_LIMIT = 0.25
MIN_PROB_EDGE = 0.05
INITIAL_CAPITAL = 10_000.0
VAR_WINDOW = 20
VAR_CONFIDENCE = 0.95
TRADING_DAYS = 252
EXPOSURE_CAP_FRACTION = 0.5
LARGEST_POSITION_CAP = 1000


def net_positions(trades: DataFrame, account: str = "account", contract: str = "contract") -> DataFrame:
    """Signed net position per (account, contract): YES adds, NO subtracts (O2 sign)."""
    signed = F.when(F.col("side") == "yes", F.col("size")).otherwise(-F.col("size"))
    return trades.groupBy(account, contract).agg(F.sum(signed).cast("bigint").alias("position"))


def account_state(positions: DataFrame, pnl: DataFrame, account: str = "account",
                  initial_capital: float = INITIAL_CAPITAL) -> DataFrame:
    """Per account: gross exposure, capital (initial + total P&L) and the last day's P&L."""
    expo = positions.groupBy(account).agg(F.sum(F.abs("position")).cast("bigint").alias("exposure"))
    p = pnl.groupBy(account).agg(
        F.sum("daily_pnl").alias("total_pnl"),
        F.max_by("daily_pnl", "date").alias("last_pnl"),
    )
    out = expo.join(p, account, "full")
    return out.select(
        account,
        F.coalesce("exposure", F.lit(0)).cast("bigint").alias("exposure"),
        (F.lit(initial_capital) + F.coalesce("total_pnl", F.lit(0.0))).alias("capital"),
        F.coalesce("last_pnl", F.lit(0.0)).alias("last_pnl"),
    )


def position_size(signals: DataFrame, state: DataFrame, account: str = "account", prob: str = "predicted_prob",
                  price: str = "market_price", confidence: str = "model_confidence",
                  min_edge: float = MIN_PROB_EDGE, max_size: int = MAX_POSITION_SIZE,
                  position_limit: int = POSITION_LIMIT, leverage: float = MAX_LEVERAGE) -> DataFrame:
    """M1: 0 under the minimum edge; else ``min(int(raw), int(min(remaining
    capacity, max size, capital * leverage / price)))``, at least 0, signed by
    the edge: an account beyond its limit, or without capital, opens nothing."""
    x = signals.join(state, account, "left")
    edge = F.col(prob) - F.col(price)
    raw = F.abs(edge) / min_edge * max_size * F.col(confidence)
    remaining = F.lit(position_limit) - F.coalesce(F.col("exposure"), F.lit(0))
    cap = F.least(remaining.cast("double"), F.lit(float(max_size)), F.col("capital") * leverage / F.col(price))
    size = F.greatest(F.least(raw.cast("bigint"), cap.cast("bigint")), F.lit(0).cast("bigint"))
    signed = F.when(F.abs(edge) < min_edge, F.lit(0)).when(edge > 0, size).otherwise(-size)
    return x.withColumn("edge", edge).withColumn("position_size", signed.cast("bigint"))


def check_limits(orders: DataFrame, size: str = "position_size", price: str = "market_price",
                 initial_capital: float = INITIAL_CAPITAL, daily_loss: float = MAX_DAILY_LOSS,
                 leverage: float = MAX_LEVERAGE, concentration: float = CONCENTRATION_LIMIT) -> DataFrame:
    """M2: ordered checks (daily loss, leverage, concentration) -> ``passes, reason``.

    Needs ``exposure, capital, last_pnl`` (from ``account_state``)."""
    daily = F.col("last_pnl") < -daily_loss * initial_capital
    new_expo = F.col("exposure") + F.abs(F.col(size))
    lev = new_expo * F.col(price) > F.col("capital") * leverage
    conc = F.abs(F.col(size)) * F.col(price) > F.col("capital") * concentration
    reason = (F.when(daily, F.lit("Daily loss limit reached")).when(lev, F.lit("Leverage limit exceeded"))
              .when(conc, F.lit("Concentration limit exceeded")).otherwise(F.lit("Passes risk checks")))
    return orders.withColumn("passes", ~(daily | lev | conc)).withColumn("reason", reason)


def risk_metrics(pnl: DataFrame, state: DataFrame, account: str = "account", date: str = "date",
                 var_window: int = VAR_WINDOW, var_confidence: float = VAR_CONFIDENCE) -> DataFrame:
    """M3: VaR (interpolated percentile of the last ``var_window`` returns),
    expected shortfall (mean of all returns below VaR), volatility x sqrt 252,
    max drawdown of the compounded returns and Sharpe; returns are daily P&L
    over the current capital."""
    x = pnl.join(state.select(account, "capital"), account, "left")
    x = x.withColumn("_r", F.col("daily_pnl") / F.col("capital"))
    w = Window.partitionBy(account).orderBy(date)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy(account).orderBy(F.col(date).desc())))
    # Compounded growth as exp(sum(log1p(r))); a return of -100% or worse
    # ruins the account (growth 0 from there on).
    ruined = F.max((F.col("_r") <= -1).cast("int")).over(run) == 1
    growth = F.when(ruined, F.lit(0.0)).otherwise(F.exp(F.sum(F.log1p(F.greatest(F.col("_r"), F.lit(-0.999999999))))
                                                        .over(run)))
    x = x.withColumn("_g", growth)
    x = x.withColumn("_dd", F.try_divide(F.col("_g"), F.max("_g").over(run)) - 1.0)
    var = x.where(F.col("_rn") <= var_window).groupBy(account).agg(
        F.percentile(F.col("_r"), F.lit(1.0 - var_confidence)).alias("value_at_risk"))
    x = x.join(var, account, "left")
    return x.groupBy(account).agg(
        F.first("value_at_risk").alias("value_at_risk"),
        F.avg(F.when(F.col("_r") < F.col("value_at_risk"), F.col("_r"))).alias("expected_shortfall"),
        (F.stddev_samp("_r") * math.sqrt(TRADING_DAYS)).alias("volatility"),
        F.min("_dd").alias("max_drawdown"),
        F.try_divide(F.avg("_r"), F.stddev_samp("_r")).alias("_s"),
    ).select(account, "value_at_risk", "expected_shortfall", "volatility", "max_drawdown",
             (F.col("_s") * math.sqrt(TRADING_DAYS)).alias("sharpe_ratio"))


def risk_report(positions: DataFrame, pnl: DataFrame, account: str = "account",
                initial_capital: float = INITIAL_CAPITAL) -> DataFrame:
    """M4: gross, largest and net exposure; total, mean, std P&L and win rate
    of days; capital and capital usage per account."""
    pos = positions.groupBy(account).agg(
        F.sum(F.abs("position")).cast("bigint").alias("total_exposure"),
        F.max(F.abs("position")).cast("bigint").alias("largest_position"),
        F.sum("position").cast("bigint").alias("net_exposure"),
    )
    perf = pnl.groupBy(account).agg(
        F.sum("daily_pnl").alias("total_pnl"),
        F.avg("daily_pnl").alias("daily_avg_pnl"),
        F.stddev_samp("daily_pnl").alias("pnl_volatility"),
        F.avg((F.col("daily_pnl") > 0).cast("double")).alias("win_rate"),
    )
    out = pos.join(perf, account, "full")
    capital = F.lit(initial_capital) + F.coalesce(F.col("total_pnl"), F.lit(0.0))
    return out.select("*", capital.alias("current_capital"),
                      F.try_divide(F.col("total_exposure").cast("double"), capital).alias("capital_usage"))


def market_adjusted_size(base: Column, volatility: Column | None = None, liquidity: Column | None = None,
                         stress: Column | None = None) -> Column:
    """M5: ``int(base / (1 + vol) * min(1, liq) * (1 - 0.5 stress))``; a null
    or absent condition leaves its factor at 1."""
    v = F.lit(1.0) if volatility is None else F.coalesce(1.0 / (1.0 + volatility), F.lit(1.0))
    lq = F.lit(1.0) if liquidity is None else F.coalesce(F.least(F.lit(1.0), liquidity), F.lit(1.0))
    s = F.lit(1.0) if stress is None else F.coalesce(1.0 - stress * 0.5, F.lit(1.0))
    return (base * v * lq * s).cast("bigint")


def _band(pct: Column) -> Column:
    return F.when(pct < 50, F.lit("green")).when(pct < 75, F.lit("orange")).otherwise(F.lit("red"))


def utilisation(positions: DataFrame, capital: DataFrame, account: str = "account", size: str = "size",
                price: str = "current_price") -> DataFrame:
    """M7: exposure against 50% of capital, largest position against 1000
    contracts and concentration (largest / total size), each as a percentage
    with a green / orange / red band."""
    g = positions.groupBy(account).agg(
        F.sum(F.col(size) * F.col(price)).alias("total_exposure"),
        F.max(size).alias("max_position"),
        F.sum(size).alias("_total_size"),
    ).join(capital, account, "left")
    cap = F.coalesce(F.col("capital"), F.lit(INITIAL_CAPITAL)) * EXPOSURE_CAP_FRACTION
    expo_pct = F.when(cap > 0, F.col("total_exposure") / cap * 100.0).otherwise(F.lit(0.0))
    large_pct = F.col("max_position") / float(LARGEST_POSITION_CAP) * 100.0
    conc = F.when(F.col("_total_size") != 0, F.col("max_position") / F.col("_total_size") * 100.0) \
        .otherwise(F.lit(0.0))
    return g.select(account, "total_exposure", F.col("max_position").cast("bigint").alias("max_position"),
                    expo_pct.alias("exposure_pct"), _band(expo_pct).alias("exposure_band"),
                    large_pct.alias("largest_pct"), _band(large_pct).alias("largest_band"),
                    conc.alias("concentration_pct"), _band(conc).alias("concentration_band"))
