"""Queries: weekly backtest, its summary and the daily ledger."""

from __future__ import annotations

import math

from paxcast.operators import backtest
from paxcast.plans.oracle_views import X1, X7, with_
from paxcast.plans.q_forecast import WEEKLY_SQL, blend_sql
from paxcast.plans.q_signals import STEP, select_sql, x4_sql
from paxcast.plans.registry import query, round_doubles, round_sql
from paxcast.sources import fixtures
from paxcast.sources.tables import Tables

# Parameters of the registered queries.
START = "1993-01-01"
CAPITAL = backtest.INITIAL_CAPITAL
BET = backtest.BET_SIZE
LEDGER_CAPITAL = 10_000.0


def _weeks(t: Tables):
    return backtest.weekly_backtest(fixtures.daily_counts(t), fixtures.quotes, start=START, step=STEP)


ELIGIBLE_SQL = f"""fb AS ({blend_sql('dense', 0.0)}),
fw AS (SELECT *, COALESCE(SUM(n_days) OVER (PARTITION BY series ORDER BY week_end
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_rows
       FROM fb),
weeks AS (
  SELECT series, CAST(week_end - 6 AS DATE) AS monday, week_end, week_idx, prediction, uncertainty, total AS actual
  FROM fw
  WHERE prior_rows >= {backtest.MIN_TRAIN_ROWS} AND n_days = 7 AND week_idx >= 52
    AND week_end - 6 >= CAST(DATE '{START}' + CAST((8 - isodow(DATE '{START}')) % 7 AS INTEGER) AS DATE))"""

CURVE_SQL = with_(X1, WEEKLY_SQL, ELIGIBLE_SQL, x4_sql("SELECT * FROM weeks"), select_sql("x4"), f"""res AS (
  SELECT w.*, c.contract_threshold, c.side, c.confidence, c.expected_value, c.price, c.decision,
         CASE WHEN c.contract_threshold IS NULL THEN 0.0
              WHEN (CASE WHEN c.side = 'yes' THEN w.actual > c.contract_threshold
                         ELSE NOT (w.actual > c.contract_threshold) END) THEN {BET} ELSE -{BET} END AS profit
  FROM weeks w LEFT JOIN choice c ON w.series = c.series AND w.week_end = c.week_end),
curve AS (
  SELECT *, {CAPITAL} + SUM(profit) OVER r AS equity
  FROM res WINDOW r AS (PARTITION BY series ORDER BY week_end ROWS UNBOUNDED PRECEDING)),
curve2 AS (
  SELECT *, MAX(equity) OVER r AS peak
  FROM curve WINDOW r AS (PARTITION BY series ORDER BY week_end ROWS UNBOUNDED PRECEDING)),
bt AS (SELECT *, (peak - equity) / NULLIF(peak, 0) AS drawdown FROM curve2)""")

WEEK_COLS = ["prediction", "uncertainty", "actual", "confidence", "expected_value", "price", "profit", "equity",
             "peak", "drawdown"]


@query("backtest_weeks", "N1 N2 N3 N4 N5", round_sql(CURVE_SQL + "SELECT * FROM bt", WEEK_COLS))
def q_backtest_weeks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(_weeks(t))


SUMMARY_SQL = CURVE_SQL + f"""
SELECT k.series, COALESCE(a.total_profit, 0.0) AS total_profit, COALESCE(a.win_rate, 0.0) AS win_rate,
       COALESCE(CASE WHEN a.num_weeks > 1 AND a.sr > 0 THEN a.mr / a.sr * {math.sqrt(52)!r} ELSE 0.0 END, 0.0)
         AS sharpe_ratio,
       COALESCE(a.max_drawdown, 0.0) AS max_drawdown, CAST(COALESCE(a.num_weeks, 0) AS BIGINT) AS num_weeks,
       COALESCE(a.avg_profit, 0.0) AS avg_profit, {CAPITAL} AS initial_capital,
       COALESCE(a.final_equity, {CAPITAL}) AS final_equity,
       LEAST({CAPITAL}, 100.0) AS bet_size, COALESCE(a.total_profit, 0.0) / {CAPITAL} * 100.0 AS total_return_pct
FROM (SELECT DISTINCT series FROM x1) k LEFT JOIN (
  SELECT series, SUM(profit) AS total_profit, COUNT(*) AS num_weeks, AVG(CAST(profit > 0 AS DOUBLE)) AS win_rate,
         AVG(profit / {BET}) AS mr, STDDEV_POP(profit / {BET}) AS sr, MAX(drawdown) AS max_drawdown,
         AVG(profit) AS avg_profit, arg_max(equity, week_end) AS final_equity
  FROM bt GROUP BY 1) a ON k.series = a.series"""


@query("backtest_summary", "N6 N10", round_sql(SUMMARY_SQL, ["total_profit", "win_rate", "sharpe_ratio",
                                                             "max_drawdown", "avg_profit", "initial_capital",
                                                             "final_equity", "bet_size", "total_return_pct"]))
def q_backtest_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    daily = fixtures.daily_counts(t)
    s = backtest.summary(_weeks(t), daily, capital=CAPITAL, bet=BET)
    return round_doubles(backtest.report(s, CAPITAL))


LEDGER_SQL = with_(X7, f"""tg AS (
  SELECT account, date, position AS target, CAST(dayofyear(date) % 89 + 5 AS DOUBLE) / 100.0 AS price FROM x7),
l1 AS (SELECT *, CAST(target AS BIGINT) AS position,
              CAST(target - COALESCE(LAG(target) OVER (PARTITION BY account ORDER BY date), 0) AS BIGINT) AS trade
       FROM tg),
l2 AS (SELECT *, abs(trade) * price * ({backtest.TRANSACTION_COST} + {backtest.SLIPPAGE}) AS costs FROM l1),
ledger AS (
  SELECT *, {LEDGER_CAPITAL} - SUM(trade * price + costs) OVER (PARTITION BY account ORDER BY date
                                                                 ROWS UNBOUNDED PRECEDING) AS cash
  FROM l2),
numbered AS (SELECT account, date, trade, price, ROW_NUMBER() OVER (PARTITION BY account ORDER BY date) AS rn FROM l2),
gains AS (SELECT * FROM (
  WITH RECURSIVE g(account, date, rn, held, cost, gain) AS (
    SELECT account, date, rn, trade, CASE WHEN trade <> 0 THEN price ELSE 0.0 END, CAST(NULL AS DOUBLE) FROM numbered WHERE rn = 1
    UNION ALL
    SELECT n.account, n.date, n.rn, g.held + n.trade,
           CASE WHEN n.trade = 0 THEN g.cost
                WHEN g.held * n.trade >= 0 THEN (g.cost * abs(g.held) + n.price * abs(n.trade)) / (abs(g.held) + abs(n.trade))
                WHEN abs(n.trade) > abs(g.held) THEN n.price ELSE g.cost END,
           CASE WHEN n.trade <> 0 AND g.held * n.trade < 0
                THEN LEAST(abs(n.trade), abs(g.held)) * (n.price - g.cost) * sign(g.held) END
    FROM g JOIN numbered n ON n.account = g.account AND n.rn = g.rn + 1)
  SELECT account, date, gain FROM g) z),
led AS (SELECT l.account, l.date, target, price, position, trade, costs, cash, cash + position * price AS equity,
               gain AS realised_pnl
        FROM ledger l JOIN gains g ON l.account = g.account AND l.date = g.date)""")

LEDGER_COLS = ["price", "costs", "cash", "equity", "realised_pnl"]


@query("daily_ledger", "N7 N8", round_sql(LEDGER_SQL + "SELECT * FROM led", LEDGER_COLS, 6))
def q_daily_ledger(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(backtest.daily_ledger(fixtures.ledger_targets(t), capital=LEDGER_CAPITAL), 6)


LEDGER_METRICS_SQL = LEDGER_SQL + f""",
m AS (
  SELECT *, equity / NULLIF(LAG(equity) OVER w, 0) - 1.0 AS ret,
         equity / MAX(equity) OVER (w ROWS UNBOUNDED PRECEDING) - 1.0 AS dd
  FROM led WINDOW w AS (PARTITION BY account ORDER BY date)),
g AS (
  SELECT account, arg_max(equity, date) AS final_equity, COUNT(ret) AS n, STDDEV_SAMP(ret) AS sd,
         MIN(dd) AS max_drawdown, CAST(SUM(CAST(trade <> 0 AS INTEGER)) AS BIGINT) AS num_trades,
         AVG(CASE WHEN trade <> 0 THEN abs(trade) * price + costs END) AS avg_trade,
         AVG(CAST(realised_pnl > 1e-9 AS DOUBLE)) AS win_rate
  FROM m GROUP BY 1),
h AS (SELECT *, final_equity / {LEDGER_CAPITAL} - 1.0 AS total_return FROM g),
i AS (SELECT *, pow(1.0 + total_return, {float(backtest.TRADING_DAYS)} / CAST(n AS DOUBLE)) - 1.0 AS annual_return,
             sd * {math.sqrt(backtest.TRADING_DAYS)!r} AS volatility FROM h)
SELECT account, total_return, annual_return, volatility, (annual_return - 0.02) / NULLIF(volatility, 0) AS sharpe_ratio,
       max_drawdown, COALESCE(win_rate, 0.0) AS win_rate, COALESCE(avg_trade, 0.0) AS avg_trade, num_trades,
       final_equity
FROM i"""


@query("daily_ledger_metrics", "N9", round_sql(LEDGER_METRICS_SQL, [
    "total_return", "annual_return", "volatility", "sharpe_ratio", "max_drawdown", "win_rate", "avg_trade",
    "final_equity"]))
def q_daily_ledger_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    led = backtest.daily_ledger(fixtures.ledger_targets(t), capital=LEDGER_CAPITAL)
    return round_doubles(backtest.ledger_metrics(led, capital=LEDGER_CAPITAL))
