"""Weekly walk-forward backtest and the daily ledger.

The weekly backtest is a replay over recorded tables: forecasts for every
week come from one window pass (I1), quotes come from a quote table, and the
only state that crosses weeks is a running sum, so there is no loop. Every
window is partitioned by the series or account key. The daily ledger's average
cost is a recurrence of one step a day, solved in closed form by running products.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paxcast.operators import forecast, resample, signals

# Backtest defaults.
INITIAL_CAPITAL = 100.0
BET_SIZE = 100.0
MIN_TRAIN_ROWS = 365
LADDER_STEP = 500_000.0
LADDER_RUNGS = (-2, -1, 0, 1, 2)
TRANSACTION_COST = 0.001
SLIPPAGE = 0.001
TRADING_DAYS = 252
WEEKS_PER_YEAR = 52


def mondays(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every Monday from ``start`` (rolled forward to a Monday) to ``end``.

    A calendar spine: its size is (end - start) / 7 rows, bounded by the
    dates asked for, not by the data.
    """
    s = F.next_day(F.date_sub(F.to_date(F.lit(start)), 1), "Mon")
    return spark.range(1).select(
        F.explode(F.sequence(s, F.to_date(F.lit(end)), F.expr("INTERVAL 7 DAYS"))).alias("monday"))


def eligible_weeks(daily: DataFrame, key: str = "series", date: str = "date", value: str = "passengers",
                   start: str | None = None, end: str | None = None, min_train_rows: int = MIN_TRAIN_ROWS,
                   default_growth: float = 0.0) -> DataFrame:
    """Forecast and actual of every week that can be traded.

    A week (Monday to Sunday) is eligible when at least ``min_train_rows``
    daily rows precede its Monday and all 7 of its days are present. ``start``
    and ``end`` bound the Monday (N1). The forecast only reads earlier weeks
    (frames end at -1).
    """
    weekly = resample.weekly_sums(daily, key, date, value)
    dense = resample.densify_weeks(weekly, key)
    f = forecast.blend_forecast(dense, key, default_growth, min_weeks=0)
    w = Window.partitionBy(key).orderBy("week_end").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("prior_rows", F.coalesce(F.sum("n_days").over(w), F.lit(0)))
    monday = F.date_sub("week_end", 6)
    keep = (F.col("prior_rows") >= min_train_rows) & (F.col("n_days") == 7) & (F.col("week_idx") >= 52)
    if start is not None:
        keep = keep & (monday >= F.next_day(F.date_sub(F.to_date(F.lit(start)), 1), "Mon"))
    if end is not None:
        keep = keep & (monday <= F.to_date(F.lit(end)))
    return f.where(keep).select(key, monday.alias("monday"), "week_end", "week_idx", "prediction", "uncertainty",
                                F.col("total").alias("actual"))


def ladder(weeks: DataFrame, step: float = LADDER_STEP, rungs=LADDER_RUNGS,
           prediction: str = "prediction", keep_invalid: bool = False) -> DataFrame:
    """Thresholds around the prediction rounded half-even to ``step``.

    Non-positive thresholds are dropped, or with ``keep_invalid`` kept and
    flagged ``valid = false`` (so a week with no valid rung still reaches
    the per-week choice as a no-trade week)."""
    base = F.rint(F.col(prediction) / step) * step
    x = weeks.withColumn("rung", F.explode(F.array(*[F.lit(r) for r in rungs])))
    x = x.withColumn("threshold", (base + F.col("rung") * step).cast("bigint"))
    if keep_invalid:
        return x.withColumn("valid", F.coalesce(F.col("threshold") > 0, F.lit(False)))
    return x.where(F.col("threshold") > 0)


def settle(choice: DataFrame, actual: str = "actual", bet: float = BET_SIZE, payoff: str = "flat",
           price: str | None = None) -> DataFrame:
    """Profit of each week's choice. YES wins when the actual is strictly
    above the threshold, NO otherwise; no trade is 0. ``payoff='flat'`` is
    +/- bet; ``'price'`` pays bet x (1/price - 1) on a win."""
    above = F.col(actual) > F.col("contract_threshold")
    won = F.when(F.col("side") == "yes", above).otherwise(~above)
    if payoff == "price" and price is not None:
        win_amount = bet * (1.0 / F.col(price) - 1.0)
    else:
        win_amount = F.lit(float(bet))
    profit = F.when(F.col("contract_threshold").isNull(), F.lit(0.0)).when(won, win_amount) \
        .otherwise(F.lit(-float(bet)))
    return choice.withColumn("profit", profit)


def equity_curve(results: DataFrame, key: str = "series", order: str = "week_end",
                 capital: float = INITIAL_CAPITAL) -> DataFrame:
    """equity = capital + running profit; drawdown from the running peak
    (the peak starts at the first post-trade equity)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = results.withColumn("equity", F.lit(float(capital)) + F.sum("profit").over(w))
    x = x.withColumn("peak", F.max("equity").over(w))
    return x.withColumn("drawdown", F.try_divide(F.col("peak") - F.col("equity"), F.col("peak")))


def summary(curve: DataFrame, keys: DataFrame, key: str = "series", capital: float = INITIAL_CAPITAL,
            bet: float = BET_SIZE, order: str = "week_end") -> DataFrame:
    """Total profit, win rate, annualised Sharpe (population std, sqrt 52),
    max drawdown, weeks, mean profit and final equity per key; a key with no
    weeks gets zeros and final equity = capital."""
    ret = F.col("profit") / bet if bet > 0 else F.lit(0.0)
    agg = curve.groupBy(key).agg(
        F.sum("profit").alias("total_profit"),
        F.count(F.lit(1)).alias("num_weeks"),
        F.avg((F.col("profit") > 0).cast("double")).alias("win_rate"),
        F.avg(ret).alias("_mr"),
        F.stddev_pop(ret).alias("_sr"),
        F.max("drawdown").alias("max_drawdown"),
        F.avg("profit").alias("avg_profit"),
        F.max_by("equity", order).alias("final_equity"),
    )
    sharpe = F.when((F.col("num_weeks") > 1) & (F.col("_sr") > 0),
                    F.col("_mr") / F.col("_sr") * math.sqrt(WEEKS_PER_YEAR)).otherwise(F.lit(0.0))
    out = keys.select(key).distinct().join(agg, key, "left")
    return out.select(
        key,
        F.coalesce("total_profit", F.lit(0.0)).alias("total_profit"),
        F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"),
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe_ratio"),
        F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"),
        F.coalesce("num_weeks", F.lit(0)).cast("bigint").alias("num_weeks"),
        F.coalesce("avg_profit", F.lit(0.0)).alias("avg_profit"),
        F.lit(float(capital)).alias("initial_capital"),
        F.coalesce("final_equity", F.lit(float(capital))).alias("final_equity"),
    )


def weekly_backtest(daily: DataFrame, quotes, key: str = "series", date: str = "date",
                    value: str = "passengers", start: str | None = None, end: str | None = None,
                    step: float = LADDER_STEP, min_ev: float = signals.MIN_EV, bet: float = BET_SIZE,
                    capital: float = INITIAL_CAPITAL, quote_keys=("series", "week_end", "rung")) -> DataFrame:
    """Weekly results with equity and drawdown.

    ``quotes`` is either a quote table with ``yes_price, no_price`` per
    ``quote_keys`` and threshold (joined to the ladder), or a function that
    prices a ladder table.
    """
    weeks = eligible_weeks(daily, key, date, value, start, end)
    lad = ladder(weeks, step, keep_invalid=True)
    if callable(quotes):
        contracts = quotes(lad)
    else:
        q = quotes.select(*quote_keys, "threshold", "yes_price", "no_price")
        contracts = lad.join(q, [*quote_keys, "threshold"], "left")
        contracts = contracts.withColumn("valid", F.col("valid") & F.col("yes_price").isNotNull())
    # The week's own columns ride through the per-week aggregation (grouping
    # on them is free: all are fixed by (key, week_end)), so the week table
    # is not joined back and its plan runs once; the aggregation reuses the
    # forecast's hash partitioning on the key.
    carry = ("monday", "week_idx", "prediction", "uncertainty", "actual")
    res = signals.select_contract(contracts, (key, "week_end"), min_ev=min_ev, carry=carry, valid="valid")
    res = settle(res, bet=bet)
    return equity_curve(res, key, "week_end", capital)


def report(summary_df: DataFrame, capital: float = INITIAL_CAPITAL) -> DataFrame:
    """bet = min(capital, 100) and percent return on capital."""
    return summary_df.select("*", F.least(F.lit(float(capital)), F.lit(100.0)).alias("bet_size"),
                             (F.col("total_profit") / float(capital) * 100.0).alias("total_return_pct"))


# --- daily ledger (N7-N9) ------------------------------------------------------

def transaction_costs(size: Column, price: Column, fee: float = TRANSACTION_COST,
                      slippage: float = SLIPPAGE) -> Column:
    """``|size| * price * (fee + slippage)``."""
    return F.abs(size) * price * (fee + slippage)


def daily_ledger(targets: DataFrame, key: str = "account", date: str = "date", target: str = "target",
                 price: str = "price", capital: float = 10_000.0) -> DataFrame:
    """trade = target - current position (a missing target holds the
    position), cash = capital - sum(size * price + costs), equity = cash +
    position * price; ``realised_pnl`` of a trade that closes something (null
    otherwise), at average cost, before costs.

    Average cost: between two crossings of zero (a spell) an account's book value, cost
    times size held, follows ``value = keep * value before + added``: buying adds
    its price, selling keeps the share still held. With K the running product of
    ``keep``, value / K is the running sum of added / K, so a spell is two window
    sums, however long it is."""
    w = Window.partitionBy(key).orderBy(date)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = targets.withColumn("_t", F.coalesce(F.last(target, ignorenulls=True).over(run), F.lit(0)))
    x = x.withColumn("position", F.col("_t").cast("bigint"))
    x = x.withColumn("_held", F.coalesce(F.lag("position").over(w), F.lit(0)).cast("bigint"))
    x = x.withColumn("trade", F.col("position") - F.col("_held"))
    x = x.withColumn("costs", transaction_costs(F.col("trade"), F.col(price)))
    x = x.withColumn("cash", F.lit(float(capital)) - F.sum(F.col("trade") * F.col(price) + F.col("costs")).over(run))
    x = x.withColumn("equity", F.col("cash") + F.col("position") * F.col(price))
    now, held = F.col("position"), F.col("_held")
    opens = (now != 0) & (F.signum(now) != F.signum(held))
    x = x.withColumn("_spell", F.sum(opens.cast("int")).over(run))
    keep = F.when(~opens & (now != 0) & (F.abs(now) < F.abs(held)), F.abs(now) / F.abs(held)).otherwise(1.0)
    added = F.when(opens, F.abs(now) * F.col(price)).when((now != 0) & (F.abs(now) > F.abs(held)), (F.abs(now) - F.abs(held)) * F.col(price))
    spell = Window.partitionBy(key, "_spell").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_log", F.sum(F.log(keep)).over(spell)).withColumn("_added", F.coalesce(added, F.lit(0.0)))
    value = F.exp("_log") * F.sum(F.col("_added") / F.exp("_log")).over(spell)
    x = x.withColumn("_cost", F.when(now != 0, value / F.abs(now)))
    x = x.withColumn("_cost", F.lag("_cost").over(w))
    closes = F.col("trade") * held < 0
    gain = F.least(F.abs("trade"), F.abs(held)) * (F.col(price) - F.col("_cost")) * F.signum(held)
    return x.withColumn("realised_pnl", F.when(closes, gain)).drop("_t", "_held", "_spell", "_log", "_added", "_cost")


def ledger_metrics(ledger: DataFrame, key: str = "account", date: str = "date", capital: float = 10_000.0,
                   risk_free: float = 0.02) -> DataFrame:
    """Total return, annual return ``(1 + total)^(252 / n_returns) - 1``,
    volatility (sample std of daily returns x sqrt 252), Sharpe
    ``(annual - rf) / volatility``, max drawdown (negative), win rate (share
    of closing trades with a positive realised P&L), mean trade value
    ``|size| * price + costs`` and the trade count."""
    w = Window.partitionBy(key).orderBy(date)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = ledger.withColumn("_ret", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1.0)
    x = x.withColumn("_peak", F.max("equity").over(run))
    x = x.withColumn("_dd", F.col("equity") / F.col("_peak") - 1.0)
    traded = F.col("trade") != 0
    g = x.groupBy(key).agg(
        F.max_by("equity", date).alias("final_equity"),
        F.count("_ret").alias("_n"),
        F.stddev_samp("_ret").alias("_sd"),
        F.min("_dd").alias("max_drawdown"),
        F.sum(traded.cast("int")).cast("bigint").alias("num_trades"),
        F.avg(F.when(traded, F.abs(F.col("trade")) * F.col("price") + F.col("costs"))).alias("avg_trade"),
        F.avg((F.col("realised_pnl") > 1e-9).cast("double")).alias("win_rate"),
    )
    total = F.col("final_equity") / capital - 1.0
    annual = F.pow(1.0 + total, F.try_divide(F.lit(float(TRADING_DAYS)), F.col("_n").cast("double"))) - 1.0
    vol = F.col("_sd") * math.sqrt(TRADING_DAYS)
    sharpe = F.try_divide(annual - risk_free, F.nullif(vol, F.lit(0.0)))
    return g.select(key, total.alias("total_return"), annual.alias("annual_return"), vol.alias("volatility"),
                    sharpe.alias("sharpe_ratio"), "max_drawdown", F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"),
                    F.coalesce("avg_trade", F.lit(0.0)).alias("avg_trade"), "num_trades", "final_equity")
