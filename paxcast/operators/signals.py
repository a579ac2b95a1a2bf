"""Probabilities, signals and contract choice over tables of forecasts and
quotes (L1-L13).

Every operator is a set of columns or one aggregation over a table keyed by
an event (``series, week_end``), a contract or an account. Per-event choices
(L9) are one ``groupBy`` with ``max_by`` on a composite ordering key: a
partial aggregate before the shuffle, no sort of the event's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paxcast.functions.stats import norm_cdf_sql

# Seasonal edge multipliers by month and by weekday (Mon = 0);
# anything not listed is 1.0.
MONTH_FACTORS = {1: 0.9, 7: 1.2, 11: 1.1, 12: 1.1}
WEEKDAY_FACTORS = {0: 1.0, 4: 1.2, 6: 0.8}

# Strategy defaults.
MIN_EDGE = 0.05
MAX_POSITION = 100
CONFIDENCE_THRESHOLD = 0.7
MAX_MODEL_DEVIATION = 0.15
RISK_LIMITS = {
    "max_daily_loss": 0.15,
    "max_position_loss": 0.10,
    "max_weekly_positions": 5,
    "min_time_to_expiry": 2,
}
HIGH_CONFIDENCE = 0.90
MIN_EV = 0.02
KELLY_MULTIPLIER = 0.25
MAX_RISK_PCT = 0.05
SIGNAL_MIN_EDGE = 0.05
SIGNAL_FULL_EDGE = 0.15


def _q(name: str) -> str:
    return f"`{name}`"


def prob_above(threshold: str, mean: str, std: str) -> Column:
    """L1: P(X > threshold) for X ~ Normal(mean, std), as a JVM expression."""
    z = f"(({_q(threshold)} - {_q(mean)}) / {_q(std)})"
    return F.expr(f"1.0 - {norm_cdf_sql(z)}")


def exceedance_probability(contracts: DataFrame, history: DataFrame, key: str = "series",
                           threshold: str = "threshold", value: str = "total",
                           prediction: str = "prediction", std: str = "uncertainty",
                           normal_weight: float = 0.7) -> DataFrame:
    """L2: blend ``normal_weight`` x normal P(X > thr) with the key's empirical
    exceedance rate ``mean(history > thr)``.

    The empirical rate is a rank, not a join: history values and distinct
    thresholds of a key are sorted together once (descending, thresholds
    before equal values) and a running count of history rows gives the number
    strictly above each threshold. Work is O(n log n) per key, never
    history x thresholds.
    """
    h = history.select(F.col(key), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_kind"))
    thr = contracts.select(F.col(key), F.col(threshold).cast("double").alias("_v"), F.lit(1).alias("_kind")).distinct()
    u = h.unionByName(thr)
    w = Window.partitionBy(key).orderBy(F.col("_v").desc(), F.col("_kind").desc())
    above = F.sum(1 - F.col("_kind")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum(1 - F.col("_kind")).over(Window.partitionBy(key))
    rates = (u.select(key, "_v", "_kind", above.alias("_above"), n.alias("_n"))
             .where(F.col("_kind") == 1)
             .select(F.col(key), F.col("_v").alias("_thr"),
                     F.try_divide(F.col("_above").cast("double"), F.col("_n").cast("double")).alias("historical_prob")))
    out = contracts.join(rates, (contracts[key] == rates[key]) & (contracts[threshold].cast("double") == rates["_thr"]),
                         "left").drop(rates[key]).drop("_thr")
    normal = prob_above(threshold, prediction, std)
    return (out.withColumn("normal_prob", normal)
            .withColumn("predicted_probability",
                        F.when(F.col("historical_prob").isNull(), F.col("normal_prob"))
                        .otherwise(normal_weight * F.col("normal_prob")
                                   + (1.0 - normal_weight) * F.col("historical_prob"))))


def contract_analysis(contracts: DataFrame, threshold: str = "threshold", mean: str = "prediction",
                      std: str = "uncertainty") -> DataFrame:
    """P(above), P(below), EV of each side, best side ('-' if none
    positive and strictly better) and best EV per contract row."""
    x = contracts.withColumn("prob_above", prob_above(threshold, mean, std))
    x = x.withColumn("prob_below", 1.0 - F.col("prob_above"))
    yes_p = F.coalesce(F.col("yes_price"), F.lit(0.5))
    no_p = F.coalesce(F.col("no_price"), F.lit(0.5))
    x = x.withColumn("ev_yes", F.col("prob_above") - yes_p).withColumn("ev_no", F.col("prob_below") - no_p)
    side = (F.when((F.col("ev_yes") > F.col("ev_no")) & (F.col("ev_yes") > 0), F.lit("YES"))
            .when((F.col("ev_no") > F.col("ev_yes")) & (F.col("ev_no") > 0), F.lit("NO"))
            .otherwise(F.lit("-")))
    best = (F.when(side == "YES", F.col("ev_yes")).when(side == "NO", F.col("ev_no"))
            .otherwise(F.greatest("ev_yes", "ev_no")))
    return x.withColumn("best_side", side).withColumn("best_ev", best)


def select_contract(contracts: DataFrame, event_keys=("series", "week_end"), position: str = "rung",
                    threshold: str = "threshold", mean: str = "prediction", std: str = "uncertainty",
                    min_ev: float = MIN_EV, high_confidence: float = HIGH_CONFIDENCE, carry=(),
                    valid: str | None = None) -> DataFrame:
    """The contract to trade for every event.

    A non-positive std becomes 5% of the prediction. If the highest
    threshold has P(above) >= ``high_confidence`` and its YES EV clears
    ``min_ev``, buy YES on it. Otherwise take the best EV over every
    (contract, side) in contract order, YES before NO, the first of equal
    EVs winning; below ``min_ev`` there is no trade.

    Returns one row per event: ``contract_threshold, side, confidence,
    expected_value, price, decision`` (null contract, side and price, 0
    figures for no trade).

    ``carry`` names event-level columns (constant within an event) kept in
    the output, so callers need no join back to their event table. With
    ``valid``, rows where that column is false are not offered; an event
    without any valid row is a no-trade row.
    """
    keys = list(event_keys) + [c for c in carry if c not in event_keys]
    sd = F.when(F.col(std) <= 0, F.col(mean) * 0.05).otherwise(F.col(std))
    x = contracts.withColumn("_sd", sd)
    x = x.withColumn("_p", prob_above(threshold, mean, "_sd"))
    yes_p = F.coalesce(F.col("yes_price"), F.lit(0.5))
    no_p = F.coalesce(F.col("no_price"), F.lit(0.5))
    opt = F.struct(F.col(threshold).alias("thr"), F.col("_p").alias("p"),
                   (F.col("_p") - yes_p).alias("ev_yes"), yes_p.alias("price"))
    # Ordering keys: EV first, then earlier position, then YES before NO.
    yes_key = F.struct((F.col("_p") - yes_p).alias("ev"), (-F.col(position)).alias("pos"), F.lit(1).alias("side"))
    no_key = F.struct(((1.0 - F.col("_p")) - no_p).alias("ev"), (-F.col(position)).alias("pos"),
                      F.lit(0).alias("side"))
    yes_opt = F.struct(F.col(threshold).alias("thr"), F.lit("yes").alias("side"), F.col("_p").alias("conf"),
                       (F.col("_p") - yes_p).alias("ev"), yes_p.alias("price"))
    no_opt = F.struct(F.col(threshold).alias("thr"), F.lit("no").alias("side"), (1.0 - F.col("_p")).alias("conf"),
                      ((1.0 - F.col("_p")) - no_p).alias("ev"), no_p.alias("price"))
    ok = F.col(valid) if valid else F.lit(True)
    # max_by skips rows whose ordering key is null: invalid rows get none.
    agg = x.groupBy(*keys).agg(
        F.max_by(opt, F.when(ok, F.col(threshold))).alias("_hi"),
        F.max_by(yes_opt, F.when(ok, yes_key)).alias("_by"),
        F.max_by(no_opt, F.when(ok, no_key)).alias("_bn"),
        F.max(F.when(ok, yes_key)).alias("_ky"),
        F.max(F.when(ok, no_key)).alias("_kn"),
    )
    best = F.when(F.col("_ky") >= F.col("_kn"), F.col("_by")).otherwise(F.col("_bn"))
    hi_ok = (F.col("_hi.p") >= high_confidence) & (F.col("_hi.ev_yes") >= min_ev)
    agg = agg.withColumn("_best", best)
    best_ok = F.coalesce(F.col("_best.ev") >= min_ev, F.lit(False))
    hi_ok = F.coalesce(hi_ok, F.lit(False))
    decision = F.when(hi_ok, F.lit("high_confidence")).when(best_ok, F.lit("best_ev")).otherwise(F.lit("no_trade"))
    return agg.select(
        *keys,
        F.when(hi_ok, F.col("_hi.thr")).when(best_ok, F.col("_best.thr")).alias("contract_threshold"),
        F.when(hi_ok, F.lit("yes")).when(best_ok, F.col("_best.side")).alias("side"),
        F.when(hi_ok, F.col("_hi.p")).when(best_ok, F.col("_best.conf")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(hi_ok, F.col("_hi.ev_yes")).when(best_ok, F.col("_best.ev")).otherwise(F.lit(0.0))
        .alias("expected_value"),
        F.when(hi_ok, F.col("_hi.price")).when(best_ok, F.col("_best.price")).alias("price"),
        decision.alias("decision"),
    )


def kelly_contracts(bankroll: Column, confidence: Column, price: Column,
                    max_risk_pct: float = MAX_RISK_PCT) -> Column:
    """Quarter-Kelly contract count capped at ``max_risk_pct`` of the bankroll."""
    edge = confidence - price
    frac = F.least(edge / (1.0 - price) * KELLY_MULTIPLIER, F.lit(max_risk_pct))
    n = F.floor(bankroll * frac / price)
    ok = (confidence > 0) & (price > 0) & (price < 1) & (edge > 0)
    return F.when(ok, F.greatest(n, F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def signal_label(df: DataFrame, prob: str = "predicted_prob", price: str = "market_price") -> DataFrame:
    """HOLD under a 5-point edge, else BUY YES / BUY NO with strength
    ``min(|edge| / 0.15, 1)``."""
    edge = F.col(prob) - F.col(price)
    label = (F.when(F.abs(edge) < SIGNAL_MIN_EDGE, F.lit("HOLD"))
             .when(edge > 0, F.lit("BUY YES")).otherwise(F.lit("BUY NO")))
    strength = F.when(F.abs(edge) < SIGNAL_MIN_EDGE, F.lit(0.0)).otherwise(
        F.least(F.abs(edge) / SIGNAL_FULL_EDGE, F.lit(1.0)))
    return df.select("*", label.alias("signal"), edge.alias("edge"), (edge * 100.0).alias("edge_pct"),
                     strength.alias("strength"))


def recommendation_tier(ev: Column, strong: float = MIN_EV) -> Column:
    """L12: 'strong' at EV >= 0.02, 'low' at EV >= 0, else 'hold'."""
    return F.when(ev >= strong, F.lit("strong")).when(ev >= 0, F.lit("low")).otherwise(F.lit("hold"))


def order_preview(orders: DataFrame, size: str = "size", price: str = "price") -> DataFrame:
    """Cost, max profit, max loss and reward/risk of each order."""
    cost = F.col(size) * F.col(price)
    profit = F.col(size) * (1.0 - F.col(price))
    return orders.select("*", cost.alias("cost"), profit.alias("max_profit"), cost.alias("max_loss"),
                         F.when(cost > 0, profit / cost).otherwise(F.lit(0.0)).alias("reward_risk"))


def seasonal_multiplier(date: Column) -> Column:
    """Month factor x weekday factor of the signal's own date."""
    m = F.month(date)
    d = F.weekday(date)
    mf = F.lit(1.0)
    for k, v in sorted(MONTH_FACTORS.items()):
        mf = F.when(m == k, F.lit(v)).otherwise(mf)
    df_ = F.lit(1.0)
    for k, v in sorted(WEEKDAY_FACTORS.items()):
        df_ = F.when(d == k, F.lit(v)).otherwise(df_)
    return mf * df_


def position_size(edge: Column, confidence: Column, days_to_expiry: Column, volume: Column, price: Column,
                  min_edge: float = MIN_EDGE, max_position: int = MAX_POSITION) -> Column:
    """Size from edge and confidence, scaled by time to expiry, liquidity
    and price extremes; truncated towards zero and capped."""
    base = F.abs(edge) / min_edge * max_position * confidence
    time_s = F.least(F.lit(1.0), (days_to_expiry - 1) / 5.0)
    liq_s = F.least(F.lit(1.0), volume / 1000.0)
    price_s = F.when((price < 0.1) | (price > 0.9), F.lit(0.5)).otherwise(F.lit(1.0))
    raw = (base * time_s * liq_s * price_s).cast("bigint")
    return F.least(raw, F.lit(max_position).cast("bigint"))


def strategy_signals(df: DataFrame, account: str = "account", ts: str = "ts",
                     prob: str = "predicted_probability", price: str = "price", confidence: str = "confidence",
                     date: str = "signal_date", min_edge: float = MIN_EDGE, max_position: int = MAX_POSITION,
                     confidence_threshold: float = CONFIDENCE_THRESHOLD, risk_limits: dict | None = None
                     ) -> DataFrame:
    """Edge, seasonal adjustment, action and size, then risk rules.

    Input rows carry ``days_to_expiry`` and ``volume`` and optionally
    ``daily_pnl_pct`` and ``position_pnl_pct`` (0 when absent). Rules apply
    in order: daily loss -> close, near expiry -> close, position loss ->
    close; otherwise, when the account already opened ``max_weekly_positions``
    positions earlier in the same week, the size becomes 0.
    """
    lim = dict(RISK_LIMITS, **(risk_limits or {}))
    x = df
    for c in ("daily_pnl_pct", "position_pnl_pct"):
        if c not in x.columns:
            x = x.withColumn(c, F.lit(0.0))
    edge = (F.col(prob) - F.col(price)) * seasonal_multiplier(F.col(date))
    x = x.withColumn("edge", edge)
    trade = (F.abs(F.col("edge")) > min_edge) & (F.col(confidence) > confidence_threshold)
    action = F.when(trade, F.when(F.col("edge") > 0, F.lit("buy")).otherwise(F.lit("sell"))).otherwise(F.lit("hold"))
    size = F.when(trade, position_size(F.col("edge"), F.col(confidence), F.col("days_to_expiry"), F.col("volume"),
                                       F.col(price), min_edge, max_position)).otherwise(F.lit(0).cast("bigint"))
    x = x.withColumn("action", action).withColumn("size", size)
    # Positions opened earlier in the same account-week (ISO week of the signal).
    wk = F.date_trunc("week", F.col(date))
    w = Window.partitionBy(account, wk).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum(F.when(F.col("action") != "hold", 1).otherwise(0)).over(w), F.lit(0))
    x = x.withColumn("weekly_positions", opened)
    close_daily = F.col("daily_pnl_pct") < -lim["max_daily_loss"]
    close_expiry = F.col("days_to_expiry") < lim["min_time_to_expiry"]
    close_pos = F.col("position_pnl_pct") < -lim["max_position_loss"]
    weekly_cap = F.col("weekly_positions") >= lim["max_weekly_positions"]
    reason = (F.when(close_daily, F.lit("Daily loss limit hit"))
              .when(close_expiry, F.lit("Too close to expiry"))
              .when(close_pos, F.lit("Position loss limit hit"))
              .when(weekly_cap, F.lit("Weekly position limit reached"))
              .when(F.col("action") == "hold", F.lit("Insufficient edge or confidence"))
              .otherwise(F.lit("Edge and confidence pass")))
    closing = close_daily | close_expiry | close_pos
    return x.select(
        *[c for c in x.columns if c not in ("action", "size")],
        F.when(closing, F.lit("close")).otherwise(F.col("action")).alias("action"),
        F.when(closing | weekly_cap, F.lit(0).cast("bigint")).otherwise(F.col("size")).alias("size"),
        reason.alias("reason"),
    )


def feature_reliability(current: DataFrame, importance: DataFrame, keys=("series", "date"), quantile: float = 0.8,
                        penalty: float = 0.8) -> DataFrame:
    """L3, feature part: ``missing_features`` and ``feature_confidence`` of every row.

    ``importance`` holds (feature, importance); the features above its interpolated
    ``quantile`` are the important ones. A row lacks those that are no column of
    ``current`` or null there; each costs a factor ``penalty``."""
    cut = importance.agg(F.percentile("importance", F.lit(quantile)).alias("cut")).select("cut").scalar()
    chosen = importance.where(F.col("importance") > cut).agg(F.collect_set("feature").alias("names")).select("names").scalar()
    names = [c for c in current.columns if c not in keys]
    present = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in names))) if names else F.array().cast("array<string>")
    missing = F.size(F.array_except(chosen, present))
    return current.select(*keys, missing.cast("bigint").alias("missing_features"), F.pow(F.lit(penalty), missing.cast("double")).alias("feature_confidence"))


def model_confidence(preds: DataFrame, keys=("series", "date"), model: str = "model", pred: str = "pred",
                     actual: str = "actual", reliability: DataFrame | None = None,
                     max_deviation: float = MAX_MODEL_DEVIATION, history: int = 30,
                     default_accuracy: float = 0.8) -> DataFrame:
    """L3: agreement-based confidence per key.

    Disagreement is the population std of the model predictions relative to
    their mean (so the 0.15 limit is scale-free). ``reliability`` is the table of
    :func:`feature_reliability` (keys without a row, or no table: nothing is
    missing); recent accuracy is the mean
    accuracy of the ensemble mean over the previous ``history`` keys of the
    series (0.8 when there is none).
    """
    keys = list(keys)
    g = preds.groupBy(*keys).agg(
        F.stddev_pop(pred).alias("_sd"), F.avg(pred).alias("_mean"), F.count(pred).alias("_n"),
        F.first(actual).alias("_actual"),
    )
    rel = F.try_divide(F.col("_sd"), F.abs(F.col("_mean")))
    acc = F.least(F.greatest(1.0 - F.abs(F.col("_mean") - F.col("_actual")) / F.col("_actual"), F.lit(0.0)),
                  F.lit(1.0))
    g = g.withColumn("model_deviation", rel).withColumn("_acc", acc)
    w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(-history, -1)
    g = g.withColumn("recent_accuracy", F.coalesce(F.avg("_acc").over(w), F.lit(default_accuracy)))
    if reliability is None:
        g = g.withColumn("missing_features", F.lit(0).cast("bigint")).withColumn("feature_confidence", F.lit(1.0))
    else:
        g = g.join(reliability.select(*keys, "missing_features", "feature_confidence"), keys, "left")
    g = g.withColumn("missing_features", F.coalesce("missing_features", F.lit(0)))
    feat = F.coalesce("feature_confidence", F.lit(1.0))
    raw = (1.0 - F.col("model_deviation") / max_deviation) * 0.4 + feat * 0.3 + F.col("recent_accuracy") * 0.3
    conf = F.when(F.col("model_deviation") > max_deviation, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    return g.select(*keys, F.col("_n").alias("models"), "missing_features", "model_deviation", feat.alias("feature_confidence"),
                    "recent_accuracy", conf.alias("confidence"))
