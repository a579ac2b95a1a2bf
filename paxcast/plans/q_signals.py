"""Queries: probabilities, contract choice, signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paxcast.functions.stats import norm_cdf_sql
from paxcast.operators import backtest, features, forecast, resample, signals
from paxcast.plans.oracle_views import X6, X8, X13, with_
from paxcast.plans.q_forecast import FORECAST_SQL, WEEKLY_SQL
from paxcast.plans.oracle_views import X1
from paxcast.plans.registry import query, round_doubles, round_sql
from paxcast.sources import fixtures
from paxcast.sources.tables import Tables

# Parameters of the registered queries: ladder step scaled to these tables
# (weekly totals of ~1.4M at sf0.01), bankroll for Kelly sizing.
STEP = 100_000.0
BANKROLL = 1000.0
WEEKLY_CAP = 3


def contracts_x4(t: Tables):
    """A five-rung ladder with quotes around every week's forecast."""
    f = forecast.weekly_forecast(fixtures.daily_counts(t))
    return fixtures.quotes(backtest.ladder(f, STEP))


def x4_sql(src: str, step: float = STEP) -> str:
    """SQL of X4 over a forecast relation ``src`` (subquery text)."""
    return f"""x4 AS (
  SELECT *, CAST((week_idx * 7 + (rung + 2) * 13) % 91 + 5 AS DOUBLE) / 100.0 AS yes_price,
         1.0 - CAST((week_idx * 7 + (rung + 2) * 13) % 91 + 5 AS DOUBLE) / 100.0 AS no_price,
         CAST((week_idx * 37) % 1500 AS DOUBLE) AS volume, CAST(rung + 3 AS BIGINT) AS days_to_expiry
  FROM (SELECT q.*, r.rung,
               CAST(round_even(q.prediction / {step}, 0) * {step} + r.rung * {step} AS BIGINT) AS threshold
        FROM ({src}) q CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) r(rung)) z
  WHERE threshold > 0)"""


def p_above_sql(thr: str, mean: str, sd: str) -> str:
    return f"(1.0 - {norm_cdf_sql(f'(({thr} - {mean}) / {sd})')})"


def select_sql(src: str, min_ev: float = signals.MIN_EV) -> str:
    """SQL of L9 over ``src(series, week_end, rung, threshold, prediction,
    uncertainty, yes_price, no_price)``; defines ``choice``."""
    return f"""cp AS (
  SELECT *, {p_above_sql('threshold', 'prediction', 'sdv')} AS p
  FROM (SELECT *, CASE WHEN uncertainty <= 0 THEN prediction * 0.05 ELSE uncertainty END AS sdv FROM {src}) z),
opts AS (
  SELECT series, week_end, rung, threshold, 'yes' AS side, p AS conf, p - yes_price AS ev, yes_price AS price,
         1 AS sk FROM cp
  UNION ALL
  SELECT series, week_end, rung, threshold, 'no', 1.0 - p, (1.0 - p) - no_price, no_price, 0 FROM cp),
best AS (SELECT * FROM opts
         QUALIFY ROW_NUMBER() OVER (PARTITION BY series, week_end ORDER BY ev DESC, rung ASC, sk DESC) = 1),
hi AS (SELECT series, week_end, threshold AS thr, p AS hp, p - yes_price AS hev, yes_price AS hprice FROM cp
       QUALIFY ROW_NUMBER() OVER (PARTITION BY series, week_end ORDER BY threshold DESC) = 1),
choice AS (
  SELECT b.series, b.week_end,
         CASE WHEN h.hp >= 0.9 AND h.hev >= {min_ev} THEN h.thr WHEN b.ev >= {min_ev} THEN b.threshold END
           AS contract_threshold,
         CASE WHEN h.hp >= 0.9 AND h.hev >= {min_ev} THEN 'yes' WHEN b.ev >= {min_ev} THEN b.side END AS side,
         CASE WHEN h.hp >= 0.9 AND h.hev >= {min_ev} THEN h.hp WHEN b.ev >= {min_ev} THEN b.conf ELSE 0.0 END
           AS confidence,
         CASE WHEN h.hp >= 0.9 AND h.hev >= {min_ev} THEN h.hev WHEN b.ev >= {min_ev} THEN b.ev ELSE 0.0 END
           AS expected_value,
         CASE WHEN h.hp >= 0.9 AND h.hev >= {min_ev} THEN h.hprice WHEN b.ev >= {min_ev} THEN b.price END AS price,
         CASE WHEN h.hp >= 0.9 AND h.hev >= {min_ev} THEN 'high_confidence' WHEN b.ev >= {min_ev} THEN 'best_ev'
              ELSE 'no_trade' END AS decision
  FROM best b JOIN hi h ON b.series = h.series AND b.week_end = h.week_end)"""


X4_SQL = x4_sql(FORECAST_SQL)

# ---------------------------------------------------------------- L9, L10, L12

CHOICE_SQL = with_(X4_SQL, select_sql("x4")) + f"""
SELECT *,
       CAST(CASE WHEN confidence > 0 AND price > 0 AND price < 1 AND confidence - price > 0
            THEN GREATEST(floor({BANKROLL} * LEAST((confidence - price) / (1.0 - price) * 0.25, 0.05) / price), 0)
            ELSE 0 END AS BIGINT) AS kelly_contracts,
       CASE WHEN expected_value >= 0.02 THEN 'strong' WHEN expected_value >= 0 THEN 'low' ELSE 'hold' END AS tier
FROM choice"""


@query("contract_choice", "L9 L10 L12", round_sql(CHOICE_SQL, ["confidence", "expected_value", "price"]))
def q_contract_choice(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = signals.select_contract(contracts_x4(t))
    c = c.withColumn("kelly_contracts", signals.kelly_contracts(F.lit(BANKROLL), F.col("confidence"), F.col("price")))
    c = c.withColumn("tier", signals.recommendation_tier(F.col("expected_value")))
    return round_doubles(c)


# ---------------------------------------------------------------- L8

ANALYSIS_SQL = with_(X4_SQL) + f"""
SELECT series, week_end, rung, threshold, prob_above, prob_below, ev_yes, ev_no,
       CASE WHEN ev_yes > ev_no AND ev_yes > 0 THEN 'YES' WHEN ev_no > ev_yes AND ev_no > 0 THEN 'NO' ELSE '-' END
         AS best_side,
       CASE WHEN ev_yes > ev_no AND ev_yes > 0 THEN ev_yes WHEN ev_no > ev_yes AND ev_no > 0 THEN ev_no
            ELSE GREATEST(ev_yes, ev_no) END AS best_ev
FROM (SELECT *, prob_above - yes_price AS ev_yes, (1.0 - prob_above) - no_price AS ev_no,
             1.0 - prob_above AS prob_below
      FROM (SELECT *, {p_above_sql('threshold', 'prediction', 'uncertainty')} AS prob_above FROM x4) a) b"""


@query("contract_analysis", "L8", round_sql(ANALYSIS_SQL, ["prob_above", "prob_below", "ev_yes", "ev_no",
                                                          "best_ev"]))
def q_contract_analysis(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = signals.contract_analysis(contracts_x4(t))
    return round_doubles(a.select("series", "week_end", "rung", "threshold", "prob_above", "prob_below",
                                  "ev_yes", "ev_no", "best_side", "best_ev"))


# ---------------------------------------------------------------- L1, L2

EXCEED_CTE = f"""ex AS (
  SELECT x4.*, {p_above_sql('x4.threshold', 'x4.prediction', 'x4.uncertainty')} AS normal_prob,
         (SELECT AVG(CAST(d.total > x4.threshold AS DOUBLE)) FROM dense d WHERE d.series = x4.series)
           AS historical_prob
  FROM x4)"""
EXCEED_SQL = with_(X1, WEEKLY_SQL, X4_SQL, EXCEED_CTE) + """
SELECT series, week_end, rung, threshold, normal_prob, historical_prob,
       0.7 * normal_prob + 0.3 * historical_prob AS predicted_probability
FROM ex"""


def _exceedance(t: Tables):
    daily = fixtures.daily_counts(t)
    history = resample.weekly_totals(daily)
    return signals.exceedance_probability(contracts_x4(t), history)


@query("exceedance_probability", "L1 L2",
       round_sql(EXCEED_SQL, ["normal_prob", "historical_prob", "predicted_probability"]))
def q_exceedance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = _exceedance(t)
    return round_doubles(e.select("series", "week_end", "rung", "threshold", "normal_prob", "historical_prob",
                                  "predicted_probability"))


# ---------------------------------------------------------------- L4-L7

def _month_factor_sql(d: str) -> str:
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in sorted(signals.MONTH_FACTORS.items()))
    return f"(CASE month({d}) {arms} ELSE 1.0 END)"


def _dow_factor_sql(d: str) -> str:
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in sorted(signals.WEEKDAY_FACTORS.items()))
    return f"(CASE isodow({d}) - 1 {arms} ELSE 1.0 END)"


_LIM = signals.RISK_LIMITS
# A position is long YES, or short below the middle rung; its P&L is the move of its
# quote since the week before. An account's
# daily P&L is the sum over its rungs. STAKE is the share of the capital in a position.
STAKE = 0.2
STRATEGY_SQL = with_(X1, WEEKLY_SQL, X4_SQL, EXCEED_CTE, f"""s0 AS (
  SELECT series AS account, week_end, rung, CAST(week_end - 6 AS DATE) AS signal_date, yes_price AS price,
         predicted_probability, 1.0 / (1.0 + uncertainty / prediction) AS confidence, volume, days_to_expiry,
         (COALESCE(yes_price / LAG(yes_price) OVER (PARTITION BY series, rung ORDER BY week_end), 1.0) - 1.0) * CASE WHEN rung < 0 THEN -{STAKE} ELSE {STAKE} END AS position_pnl_pct
  FROM (SELECT *, 0.7 * normal_prob + 0.3 * historical_prob AS predicted_probability FROM ex) e),
s1 AS (
  SELECT *, (predicted_probability - price) * {_month_factor_sql('signal_date')} * {_dow_factor_sql('signal_date')}
            AS edge, SUM(position_pnl_pct) OVER (PARTITION BY account, week_end) AS daily_pnl_pct FROM s0),
s2 AS (
  SELECT *, abs(edge) > {signals.MIN_EDGE} AND confidence > {signals.CONFIDENCE_THRESHOLD} AS trade FROM s1),
s3 AS (
  SELECT *, CASE WHEN trade THEN CASE WHEN edge > 0 THEN 'buy' ELSE 'sell' END ELSE 'hold' END AS action0,
         CASE WHEN trade THEN LEAST(CAST(trunc(abs(edge) / {signals.MIN_EDGE} * {signals.MAX_POSITION} * confidence
                   * LEAST(1.0, (days_to_expiry - 1) / 5.0) * LEAST(1.0, volume / 1000.0)
                   * CASE WHEN price < 0.1 OR price > 0.9 THEN 0.5 ELSE 1.0 END) AS BIGINT), {signals.MAX_POSITION})
              ELSE 0 END AS size0
  FROM s2),
s4 AS (
  SELECT *, COALESCE(SUM(CASE WHEN action0 <> 'hold' THEN 1 ELSE 0 END) OVER (
              PARTITION BY account, date_trunc('week', signal_date) ORDER BY rung
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weekly_positions,
         daily_pnl_pct < -{_LIM['max_daily_loss']} AS daily_loss, days_to_expiry < {_LIM['min_time_to_expiry']} AS expiring,
         position_pnl_pct < -{_LIM['max_position_loss']} AS position_loss
  FROM s3)""") + f"""
SELECT account, week_end, rung, edge, daily_pnl_pct, position_pnl_pct, CAST(weekly_positions AS BIGINT) AS weekly_positions,
       CASE WHEN daily_loss OR expiring OR position_loss THEN 'close' ELSE action0 END AS action,
       CAST(CASE WHEN daily_loss OR expiring OR position_loss OR weekly_positions >= {WEEKLY_CAP} THEN 0 ELSE size0 END AS BIGINT) AS size,
       CASE WHEN daily_loss THEN 'Daily loss limit hit'
            WHEN expiring THEN 'Too close to expiry'
            WHEN position_loss THEN 'Position loss limit hit'
            WHEN weekly_positions >= {WEEKLY_CAP} THEN 'Weekly position limit reached'
            WHEN action0 = 'hold' THEN 'Insufficient edge or confidence'
            ELSE 'Edge and confidence pass' END AS reason
FROM s4"""


@query("strategy_signals", "L4 L5 L6 L7", round_sql(STRATEGY_SQL, ["edge", "daily_pnl_pct", "position_pnl_pct"]))
def q_strategy_signals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = _exceedance(t)
    before = F.lag("yes_price").over(Window.partitionBy("series", "rung").orderBy("week_end"))
    x = e.select(
        F.col("series").alias("account"), "week_end", "rung", F.date_sub("week_end", 6).alias("signal_date"),
        F.col("yes_price").alias("price"), "predicted_probability",
        (1.0 / (1.0 + F.col("uncertainty") / F.col("prediction"))).alias("confidence"), "volume", "days_to_expiry",
        ((F.coalesce(F.col("yes_price") / before, F.lit(1.0)) - 1.0) * F.when(F.col("rung") < 0, -STAKE).otherwise(STAKE)).alias("position_pnl_pct"),
    )
    x = x.withColumn("daily_pnl_pct", F.sum("position_pnl_pct").over(Window.partitionBy("account", "week_end")))
    s = signals.strategy_signals(x, account="account", ts="rung", risk_limits={"max_weekly_positions": WEEKLY_CAP})
    return round_doubles(s.select("account", "week_end", "rung", "edge", "daily_pnl_pct", "position_pnl_pct", "weekly_positions",
                                  "action", "size", "reason"))


# ---------------------------------------------------------------- L3

FEATURES = ["day_of_week", "month", "is_weekend", "lag_1", "lag_7", "rolling_mean_7", "rolling_std_7"]
CONF_SQL = with_(X8, """feat AS (
  SELECT series, date, passengers AS target, CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, CAST(month(date) AS BIGINT) AS month,
         CAST(isodow(date) IN (6, 7) AS BIGINT) AS is_weekend, LAG(passengers, 1) OVER w AS lag_1, LAG(passengers, 7) OVER w AS lag_7,
         CASE WHEN COUNT(passengers) OVER r7 = 7 THEN AVG(passengers) OVER r7 END AS rolling_mean_7,
         CASE WHEN COUNT(passengers) OVER r7 = 7 THEN STDDEV_SAMP(passengers) OVER r7 END AS rolling_std_7
  FROM x1 WINDOW w AS (PARTITION BY series ORDER BY date), r7 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))""",
                 "imp AS (" + " UNION ALL ".join(
                     f"SELECT '{c}' AS feature, abs(corr(CAST({c} AS DOUBLE), target)) AS importance FROM feat" for c in FEATURES) + ")",
                 """important AS (SELECT feature FROM imp WHERE importance > (SELECT quantile_cont(importance, 0.8) FROM imp))""",
                 "rel AS (SELECT series, date, CAST(" + " + ".join(
                     f"CASE WHEN {c} IS NULL AND '{c}' IN (SELECT feature FROM important) THEN 1 ELSE 0 END" for c in FEATURES)
                 + " AS BIGINT) AS missing_features FROM feat)") + f""",
g AS (SELECT series, date, STDDEV_POP(pred) AS sd, AVG(pred) AS mean_pred, COUNT(pred) AS n, FIRST(actual) AS actual
      FROM x8 GROUP BY 1, 2),
h AS (SELECT *, sd / NULLIF(abs(mean_pred), 0) AS model_deviation,
             LEAST(GREATEST(1.0 - abs(mean_pred - actual) / actual, 0.0), 1.0) AS acc FROM g),
k AS (SELECT h.*, COALESCE(AVG(acc) OVER (PARTITION BY h.series ORDER BY h.date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
                         0.8) AS recent_accuracy, COALESCE(missing_features, 0) AS missing_features,
             pow(0.8, CAST(COALESCE(missing_features, 0) AS DOUBLE)) AS feature_confidence
      FROM h LEFT JOIN rel ON rel.series = h.series AND rel.date = h.date)
SELECT series, date, CAST(n AS BIGINT) AS models, missing_features, model_deviation, feature_confidence, recent_accuracy,
       CASE WHEN model_deviation > {signals.MAX_MODEL_DEVIATION} THEN 0.0
            ELSE LEAST(1.0, GREATEST(0.0, (1.0 - model_deviation / {signals.MAX_MODEL_DEVIATION}) * 0.4
                                            + feature_confidence * 0.3 + recent_accuracy * 0.3)) END AS confidence
FROM k"""


@query("model_confidence", "L3", round_sql(CONF_SQL, ["model_deviation", "feature_confidence", "recent_accuracy",
                                                      "confidence"]))
def q_model_confidence(spark, sf_dir):
    """A feature's importance is its absolute correlation with the target; rows early in a
    series lack the lagged ones."""
    t = Tables(spark, sf_dir)
    current = features.training_matrix(fixtures.daily_counts(t), complete=False)
    strength = current.agg(F.array(*(F.struct(F.lit(c).alias("feature"), F.abs(F.corr(F.col(c).cast("double"), "target")).alias("importance"))
                                     for c in FEATURES)).alias("_f")).select(F.inline("_f"))
    reliability = signals.feature_reliability(current.drop("target"), strength)
    return round_doubles(signals.model_confidence(fixtures.model_predictions(t), reliability=reliability))


# ---------------------------------------------------------------- L11

LABEL_SQL = with_(X13) + """
SELECT event_id, prob AS predicted_prob, price AS market_price,
       CASE WHEN abs(prob - price) < 0.05 THEN 'HOLD' WHEN prob - price > 0 THEN 'BUY YES' ELSE 'BUY NO' END AS signal,
       prob - price AS edge, (prob - price) * 100.0 AS edge_pct,
       CASE WHEN abs(prob - price) < 0.05 THEN 0.0 ELSE LEAST(abs(prob - price) / 0.15, 1.0) END AS strength
FROM x13"""


@query("signal_labels", "L11", round_sql(LABEL_SQL, ["predicted_prob", "market_price", "edge", "edge_pct",
                                                     "strength"]))
def q_signal_labels(spark, sf_dir):
    t = Tables(spark, sf_dir)
    b = fixtures.binary_forecasts(t).select("event_id", F.col("prob").alias("predicted_prob"),
                                             F.col("price").alias("market_price"))
    return round_doubles(signals.signal_label(b))


# ---------------------------------------------------------------- L13

PREVIEW_SQL = with_(X6) + """
SELECT event_id, side, size, price, size * price AS cost, size * (1.0 - price) AS max_profit, size * price AS max_loss,
       CASE WHEN size * price > 0 THEN size * (1.0 - price) / (size * price) ELSE 0.0 END AS reward_risk
FROM x6"""


@query("order_preview", "L13", round_sql(PREVIEW_SQL, ["price", "cost", "max_profit", "max_loss", "reward_risk"]))
def q_order_preview(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = fixtures.trades(t).select("event_id", "side", "size", "price")
    return round_doubles(signals.order_preview(o))
