"""Queries: risk, portfolio reports and evaluation metrics (M1-M5, M7,
O1-O7, P1-P3, J9, J10, J12)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from paxcast.operators import backtest, forecast, metrics, portfolio, resample, risk
from paxcast.plans.oracle_views import X6, X7, X8, X12, X13, with_
from paxcast.plans.q_backtest import LEDGER_CAPITAL, LEDGER_SQL
from paxcast.plans.q_forecast import FORECAST_SQL
from paxcast.plans.registry import query, round_doubles, round_sql
from paxcast.sources import fixtures
from paxcast.sources.tables import Tables

CAP = risk.INITIAL_CAPITAL


def _k():
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def _pnl(t):
    return resample.daily_pnl(fixtures.trades(t))


def _state(t):
    return risk.account_state(risk.net_positions(fixtures.trades(t)), _pnl(t))


PNL_SQL = """per_day AS (SELECT account, CAST(ts AS DATE) AS date, SUM(pnl) AS pnl FROM x6 GROUP BY 1, 2),
bounds AS (SELECT account, MIN(date) AS lo, MAX(date) AS hi FROM per_day GROUP BY 1),
spine AS (SELECT account, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
dpnl AS (SELECT s.account, s.date, COALESCE(p.pnl, 0.0) AS daily_pnl,
                SUM(COALESCE(p.pnl, 0.0)) OVER (PARTITION BY s.account ORDER BY s.date ROWS UNBOUNDED PRECEDING)
                  AS cumulative_pnl
         FROM spine s LEFT JOIN per_day p ON s.account = p.account AND s.date = p.date),
npos AS (SELECT account, contract, CAST(SUM(CASE WHEN side = 'yes' THEN size ELSE -size END) AS BIGINT) AS position
         FROM x6 GROUP BY 1, 2),
state AS (
  SELECT COALESCE(e.account, p.account) AS account, CAST(COALESCE(e.exposure, 0) AS BIGINT) AS exposure,
         """ + f"{CAP}" + """ + COALESCE(p.total_pnl, 0.0) AS capital, COALESCE(p.last_pnl, 0.0) AS last_pnl
  FROM (SELECT account, SUM(abs(position)) AS exposure FROM npos GROUP BY 1) e
  FULL JOIN (SELECT account, SUM(daily_pnl) AS total_pnl, arg_max(daily_pnl, date) AS last_pnl FROM dpnl GROUP BY 1) p
  ON e.account = p.account)"""

# ---------------------------------------------------------------- M1, M2, M5

SIZING_SQL = with_(X6, PNL_SQL, f"""sig AS (
  SELECT event_id, 'U' || CAST(user_id % 5 AS VARCHAR) AS account, 'C' || CAST(user_id % 25 AS VARCHAR) AS contract,
         (CAST(json_extract_string(props, '$.k') AS INTEGER) + 0.5) / 100.0 AS predicted_prob,
         (event_id % 97 + 1) / 100.0 AS market_price, LEAST(value / 100.0, 1.0) AS model_confidence
  FROM events),
cond AS (SELECT contract, STDDEV_POP(price) AS volatility, COUNT(*) / 400.0 AS liquidity,
                AVG(CAST(pnl < 0 AS DOUBLE)) AS market_stress FROM x6 GROUP BY 1),
s1 AS (
  SELECT s.*, st.exposure, st.capital, st.last_pnl, s.predicted_prob - s.market_price AS edge,
         GREATEST(0, LEAST(CAST(trunc(abs(s.predicted_prob - s.market_price) / {risk.MIN_PROB_EDGE} * {risk.MAX_POSITION_SIZE}
                          * s.model_confidence) AS BIGINT),
               CAST(trunc(LEAST(CAST({risk.POSITION_LIMIT} - COALESCE(st.exposure, 0) AS DOUBLE),
                                {float(risk.MAX_POSITION_SIZE)}, st.capital * {risk.MAX_LEVERAGE} / s.market_price))
                    AS BIGINT))) AS sz
  FROM sig s LEFT JOIN state st ON s.account = st.account),
s2 AS (
  SELECT *, CAST(CASE WHEN abs(edge) < {risk.MIN_PROB_EDGE} THEN 0 WHEN edge > 0 THEN sz ELSE -sz END AS BIGINT)
              AS position_size FROM s1),
s3 AS (
  SELECT s2.*,
         last_pnl < -{risk.MAX_DAILY_LOSS} * {CAP} AS c_daily,
         (exposure + abs(position_size)) * market_price > capital * {risk.MAX_LEVERAGE} AS c_lev,
         abs(position_size) * market_price > capital * {risk.CONCENTRATION_LIMIT} AS c_conc,
         CAST(trunc(position_size * COALESCE(1.0 / (1.0 + c.volatility), 1.0)
                    * COALESCE(LEAST(1.0, c.liquidity), 1.0) * COALESCE(1.0 - c.market_stress * 0.5, 1.0)) AS BIGINT)
           AS adjusted_size
  FROM s2 LEFT JOIN cond c ON s2.contract = c.contract)""") + """
SELECT event_id, account, contract, edge, position_size, NOT (c_daily OR c_lev OR c_conc) AS passes,
       CASE WHEN c_daily THEN 'Daily loss limit reached' WHEN c_lev THEN 'Leverage limit exceeded'
            WHEN c_conc THEN 'Concentration limit exceeded' ELSE 'Passes risk checks' END AS reason,
       adjusted_size
FROM s3"""


@query("risk_position_size", "M1 M2 M5", round_sql(SIZING_SQL, ["edge"]))
def q_risk_position_size(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = t.events
    sig = e.select(
        "event_id",
        F.concat(F.lit("U"), (F.col("user_id") % 5).cast("string")).alias("account"),
        F.concat(F.lit("C"), (F.col("user_id") % 25).cast("string")).alias("contract"),
        ((_k() + 0.5) / 100.0).alias("predicted_prob"),
        ((F.col("event_id") % 97 + 1) / 100.0).alias("market_price"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("model_confidence"),
    )
    sized = risk.position_size(sig, _state(t))
    checked = risk.check_limits(sized)
    tr = fixtures.trades(t)
    cond = tr.groupBy("contract").agg(F.stddev_pop("price").alias("volatility"),
                                      (F.count(F.lit(1)) / 400.0).alias("liquidity"),
                                      F.avg((F.col("pnl") < 0).cast("double")).alias("market_stress"))
    x = checked.join(cond, "contract", "left")
    x = x.withColumn("adjusted_size", risk.market_adjusted_size(F.col("position_size"), F.col("volatility"),
                                                                F.col("liquidity"), F.col("market_stress")))
    return round_doubles(x.select("event_id", "account", "contract", "edge", "position_size", "passes", "reason",
                                  "adjusted_size"))


# ---------------------------------------------------------------- M3

RISK_METRICS_SQL = with_(X6, PNL_SQL, f"""r AS (
  SELECT d.account, d.date, d.daily_pnl / s.capital AS ret,
         ROW_NUMBER() OVER (PARTITION BY d.account ORDER BY d.date DESC) AS rn
  FROM dpnl d LEFT JOIN state s ON d.account = s.account),
g AS (
  SELECT *, CASE WHEN MAX(CAST(ret <= -1 AS INTEGER)) OVER run = 1 THEN 0.0
                 ELSE exp(SUM(ln(1 + GREATEST(ret, -0.999999999))) OVER run) END AS growth
  FROM r WINDOW run AS (PARTITION BY account ORDER BY date ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT *, growth / MAX(growth) OVER (PARTITION BY account ORDER BY date ROWS UNBOUNDED PRECEDING) - 1.0 AS ddv
       FROM g),
var AS (SELECT account, quantile_cont(ret, {1.0 - risk.VAR_CONFIDENCE!r}) AS value_at_risk FROM r
        WHERE rn <= {risk.VAR_WINDOW} GROUP BY 1)""") + f"""
SELECT d.account, v.value_at_risk, AVG(CASE WHEN d.ret < v.value_at_risk THEN d.ret END) AS expected_shortfall,
       STDDEV_SAMP(d.ret) * {math.sqrt(252)!r} AS volatility, MIN(d.ddv) AS max_drawdown,
       AVG(d.ret) / NULLIF(STDDEV_SAMP(d.ret), 0) * {math.sqrt(252)!r} AS sharpe_ratio
FROM dd d LEFT JOIN var v ON d.account = v.account GROUP BY d.account, v.value_at_risk"""


@query("risk_metrics", "M3", round_sql(RISK_METRICS_SQL, ["value_at_risk", "expected_shortfall", "volatility",
                                                          "max_drawdown", "sharpe_ratio"], 6))
def q_risk_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(risk.risk_metrics(_pnl(t), _state(t)), 6)


# ---------------------------------------------------------------- M4, M7

POS_SQL = """pos AS (
  SELECT account, contract, side, CAST(SUM(size) AS BIGINT) AS size,
         SUM(size * price) / NULLIF(SUM(size), 0) AS avg_price, arg_max(price, (ts, event_id)) AS current_price
  FROM x6 GROUP BY 1, 2, 3)"""

REPORT_SQL = with_(X6, PNL_SQL, POS_SQL, f"""rep AS (
  SELECT COALESCE(a.account, b.account) AS account, a.total_exposure, a.largest_position, a.net_exposure,
         b.total_pnl, b.daily_avg_pnl, b.pnl_volatility, b.win_rate,
         {CAP} + COALESCE(b.total_pnl, 0.0) AS current_capital,
         CAST(a.total_exposure AS DOUBLE) / ({CAP} + COALESCE(b.total_pnl, 0.0)) AS capital_usage
  FROM (SELECT account, CAST(SUM(abs(position)) AS BIGINT) AS total_exposure,
               CAST(MAX(abs(position)) AS BIGINT) AS largest_position, CAST(SUM(position) AS BIGINT) AS net_exposure
        FROM npos GROUP BY 1) a
  FULL JOIN (SELECT account, SUM(daily_pnl) AS total_pnl, AVG(daily_pnl) AS daily_avg_pnl,
                    STDDEV_SAMP(daily_pnl) AS pnl_volatility, AVG(CAST(daily_pnl > 0 AS DOUBLE)) AS win_rate
             FROM dpnl GROUP BY 1) b ON a.account = b.account),
util AS (
  SELECT g.account, g.total_exposure AS util_exposure, CAST(g.max_position AS BIGINT) AS max_position,
         CASE WHEN COALESCE(s.capital, {CAP}) * 0.5 > 0 THEN g.total_exposure / (COALESCE(s.capital, {CAP}) * 0.5) * 100.0
              ELSE 0.0 END AS exposure_pct,
         g.max_position / 1000.0 * 100.0 AS largest_pct,
         CASE WHEN g.ts_ <> 0 THEN g.max_position / g.ts_ * 100.0 ELSE 0.0 END AS concentration_pct
  FROM (SELECT account, SUM(size * current_price) AS total_exposure, MAX(size) AS max_position, SUM(size) AS ts_
        FROM pos GROUP BY 1) g LEFT JOIN state s ON g.account = s.account)""") + """
SELECT r.*, u.util_exposure, u.max_position, u.exposure_pct,
       CASE WHEN u.exposure_pct < 50 THEN 'green' WHEN u.exposure_pct < 75 THEN 'orange' ELSE 'red' END AS exposure_band,
       u.largest_pct,
       CASE WHEN u.largest_pct < 50 THEN 'green' WHEN u.largest_pct < 75 THEN 'orange' ELSE 'red' END AS largest_band,
       u.concentration_pct,
       CASE WHEN u.concentration_pct < 50 THEN 'green' WHEN u.concentration_pct < 75 THEN 'orange' ELSE 'red' END
         AS concentration_band
FROM rep r LEFT JOIN util u ON r.account = u.account"""


@query("portfolio_risk_report", "M4 M7", round_sql(REPORT_SQL, [
    "total_pnl", "daily_avg_pnl", "pnl_volatility", "win_rate", "current_capital", "capital_usage",
    "util_exposure", "exposure_pct", "largest_pct", "concentration_pct"]))
def q_portfolio_risk_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tr = fixtures.trades(t)
    npos = risk.net_positions(tr)
    pnl = _pnl(t)
    rep = risk.risk_report(npos, pnl)
    state = risk.account_state(npos, pnl)
    util = risk.utilisation(portfolio.positions_from_trades(tr), state.select("account", "capital"))
    util = util.withColumnRenamed("total_exposure", "util_exposure")
    return round_doubles(rep.join(util, "account", "left"))


# ---------------------------------------------------------------- O1, O2

POSITIONS_SQL = with_(X6, POS_SQL) + """
SELECT *, CAST(CASE WHEN side = 'yes' THEN size ELSE -size END AS BIGINT) AS signed_size FROM pos"""


@query("positions", "O2", round_sql(POSITIONS_SQL, ["avg_price", "current_price"]))
def q_positions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(portfolio.signed_positions(portfolio.positions_from_trades(fixtures.trades(t))))


POS_SUMMARY_SQL = with_(X6, POS_SQL) + """
SELECT account, SUM(size * avg_price) AS total_invested, SUM(size * (current_price - avg_price)) AS unrealized_pnl,
       COUNT(*) AS positions,
       CASE WHEN SUM(size * avg_price) > 0 THEN SUM(size * (current_price - avg_price)) / SUM(size * avg_price) * 100.0
            ELSE 0.0 END AS unrealized_pct
FROM pos GROUP BY 1"""


@query("position_summary", "O1", round_sql(POS_SUMMARY_SQL, ["total_invested", "unrealized_pnl",
                                                             "unrealized_pct"]))
def q_position_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(portfolio.position_summary(portfolio.positions_from_trades(fixtures.trades(t))))


# ---------------------------------------------------------------- O3, O4

PNL_STATS_SQL = with_(X6, PNL_SQL) + f"""
SELECT account, arg_max(cumulative_pnl, date) AS total_pnl, AVG(daily_pnl) AS daily_avg, MAX(daily_pnl) AS best_day,
       MIN(daily_pnl) AS worst_day, arg_max(cumulative_pnl, date) / {CAP} * 100.0 AS total_pct
FROM dpnl GROUP BY 1"""


@query("pnl_statistics", "O3", round_sql(PNL_STATS_SQL, ["total_pnl", "daily_avg", "best_day", "worst_day",
                                                         "total_pct"]))
def q_pnl_statistics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(portfolio.pnl_statistics(_pnl(t)))


TRADE_STATS_SQL = with_(X6) + """
SELECT account, COUNT(*) AS total_trades,
       SUM(CAST(pnl > 0 AS INTEGER)) / COUNT(*) * 100.0 AS win_rate_pct,
       COALESCE(CASE WHEN abs(AVG(pnl) FILTER (WHERE pnl < 0)) > 0
                     THEN AVG(pnl) FILTER (WHERE pnl > 0) / abs(AVG(pnl) FILTER (WHERE pnl < 0)) ELSE 0.0 END, 0.0)
         AS profit_factor,
       CAST(SUM(size) AS BIGINT) AS total_volume
FROM x6 GROUP BY 1"""


@query("trade_statistics", "O4", round_sql(TRADE_STATS_SQL, ["win_rate_pct", "profit_factor"]))
def q_trade_statistics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(portfolio.trade_statistics(fixtures.trades(t)))


# ---------------------------------------------------------------- O5, O6

BOOK_ORDER = "PARTITION BY market, side ORDER BY CASE WHEN side = 'bid' THEN -price_cents ELSE price_cents END, event_id"
DEPTH_SQL = with_(X12) + f"""
SELECT market, side, event_id, price_cents / 100.0 AS price, size,
       SUM(size) OVER ({BOOK_ORDER} ROWS UNBOUNDED PRECEDING) AS cumulative_size
FROM x12"""


@query("book_depth", "O5", round_sql(DEPTH_SQL, ["price"]))
def q_book_depth(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(portfolio.book_depth(fixtures.order_book(t)))


TOP_SQL = with_(X12) + f"""
SELECT market, side, level, price, size FROM (
  SELECT market, side, ROW_NUMBER() OVER ({BOOK_ORDER}) AS level, price_cents / 100.0 AS price, size FROM x12) z
WHERE level <= 5"""


@query("top_of_book", "O6", round_sql(TOP_SQL, ["price"]))
def q_top_of_book(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(portfolio.top_of_book(fixtures.order_book(t)))


SPREAD_SQL = with_(X12) + """
SELECT market, bid / 100.0 AS best_bid, ask / 100.0 AS best_ask, COALESCE(ask / 100.0 - bid / 100.0, 0.0) AS spread
FROM (SELECT market, MAX(price_cents) FILTER (WHERE side = 'bid') AS bid,
             MIN(price_cents) FILTER (WHERE side = 'ask') AS ask FROM x12 GROUP BY 1) z"""


@query("book_spread", "O6", round_sql(SPREAD_SQL, ["best_bid", "best_ask", "spread"]))
def q_book_spread(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(portfolio.spread(fixtures.order_book(t)))


# ---------------------------------------------------------------- O7

DIRECTION_SQL = LEDGER_SQL + """
SELECT account, arg_min(equity, date) AS start_equity, arg_max(equity, date) AS end_equity,
       CASE WHEN arg_max(equity, date) >= arg_min(equity, date) THEN 'up' ELSE 'down' END AS direction
FROM led GROUP BY 1"""


@query("equity_direction", "O7", round_sql(DIRECTION_SQL, ["start_equity", "end_equity"]))
def q_equity_direction(spark, sf_dir):
    t = Tables(spark, sf_dir)
    led = backtest.daily_ledger(fixtures.ledger_targets(t), capital=LEDGER_CAPITAL)
    return round_doubles(portfolio.equity_direction(led))


# ---------------------------------------------------------------- P1, J9

MODEL_METRICS_SQL = with_(X8) + """
SELECT series, model, sqrt(AVG((pred - actual) * (pred - actual))) AS rmse, AVG(abs(pred - actual)) AS mae,
       1.0 - SUM((pred - actual) * (pred - actual)) / NULLIF(VAR_POP(actual) * COUNT(actual), 0) AS r2,
       AVG(abs((pred - actual) / NULLIF(actual, 0))) * 100.0 AS mape
FROM x8 GROUP BY 1, 2"""


@query("model_metrics", "P1 J9", round_sql(MODEL_METRICS_SQL, ["rmse", "mae", "r2", "mape"]))
def q_model_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(metrics.prediction_metrics(fixtures.model_predictions(t), keys=("series", "model")))


# ---------------------------------------------------------------- P2

TRADING_SQL = with_(X7) + f""",
g AS (SELECT *, exp(SUM(ln(1 + ret)) OVER run) AS growth,
             CASE WHEN LAG(position) OVER w IS NULL OR LAG(position) OVER w <> position THEN 1 ELSE 0 END AS chg
      FROM x7 WINDOW w AS (PARTITION BY account ORDER BY date),
                     run AS (PARTITION BY account ORDER BY date ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, growth / MAX(growth) OVER (PARTITION BY account ORDER BY date ROWS UNBOUNDED PRECEDING) - 1.0 AS dd
      FROM g),
a AS (SELECT account, exp(SUM(ln(1 + ret))) - 1.0 AS total_return, COUNT(ret) AS n, STDDEV_SAMP(ret) AS sd,
             MIN(dd) AS max_drawdown, AVG(abs(position)) AS avg_position,
             CAST(SUM(chg) AS BIGINT) AS position_changes FROM d GROUP BY 1),
b AS (SELECT *, pow(1.0 + total_return, 252.0 / n) - 1.0 AS annual_return, sd * {math.sqrt(252)!r} AS volatility
      FROM a)
SELECT account, total_return, annual_return, volatility,
       CASE WHEN volatility <> 0 THEN (annual_return - 0.02) / volatility ELSE 0.0 END AS sharpe_ratio,
       max_drawdown, avg_position, position_changes
FROM b"""


@query("trading_metrics", "P2", round_sql(TRADING_SQL, ["total_return", "annual_return", "volatility",
                                                        "sharpe_ratio", "max_drawdown", "avg_position"]))
def q_trading_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(metrics.trading_metrics(fixtures.returns(t)))


# ---------------------------------------------------------------- P3

CONTRACT_METRICS_SQL = with_(X13) + """
SELECT date, AVG(CAST(round_even(prob, 0) = outcome AS DOUBLE)) AS prediction_accuracy,
       AVG(prob - price) AS average_edge,
       SUM(CASE WHEN prob > price THEN outcome - price ELSE 0.0 END) AS theoretical_pnl,
       CASE WHEN STDDEV_SAMP(prob - price) <> 0 THEN AVG(prob - price) / STDDEV_SAMP(prob - price) ELSE 0.0 END
         AS edge_sharpe
FROM x13 GROUP BY 1"""


@query("contract_metrics", "P3", round_sql(CONTRACT_METRICS_SQL, ["prediction_accuracy", "average_edge",
                                                                  "theoretical_pnl", "edge_sharpe"]))
def q_contract_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(metrics.contract_metrics(fixtures.binary_forecasts(t), keys=("date",)))


# ---------------------------------------------------------------- J10

ACC_TRACK_SQL = with_(X8) + """,
per AS (SELECT series, date, AVG(LEAST(GREATEST(1.0 - abs(pred - actual) / actual, 0.0), 1.0)) AS accuracy
        FROM x8 GROUP BY 1, 2)
SELECT series, AVG(accuracy) AS mean_accuracy, STDDEV_SAMP(accuracy) AS std_accuracy
FROM (SELECT *, MAX(date) OVER (PARTITION BY series) AS mx FROM per) z
WHERE date > mx - 30 GROUP BY 1"""


@query("accuracy_tracking", "J10", round_sql(ACC_TRACK_SQL, ["mean_accuracy", "std_accuracy"]))
def q_accuracy_tracking(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(metrics.accuracy_by_time(fixtures.model_predictions(t), keys=("series",), last_days=30))


# ---------------------------------------------------------------- J12

COVERAGE_SQL = f"""SELECT series, AVG(CAST(actual BETWEEN lower_bound AND upper_bound AS DOUBLE)) AS coverage,
       AVG(uncertainty) AS mean_uncertainty, AVG((prediction - actual) * (prediction - actual)) AS mse
FROM ({FORECAST_SQL}) q GROUP BY 1"""


@query("interval_coverage", "J12", round_sql(COVERAGE_SQL, ["coverage", "mean_uncertainty", "mse"], 2))
def q_interval_coverage(spark, sf_dir):
    t = Tables(spark, sf_dir)
    f = forecast.weekly_forecast(fixtures.daily_counts(t))
    return round_doubles(metrics.interval_coverage(f, keys=("series",)), 2)
