"""Portfolio reporting: positions, P&L and trade statistics, order-book
depth, equity direction (O1-O7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions_from_trades(trades: DataFrame, account: str = "account", market: str = "contract",
                          ts: str = "ts") -> DataFrame:
    """Open positions per (account, market, side): total size, size-weighted
    average price, and the latest traded price as the current price."""
    return trades.groupBy(account, market, "side").agg(
        F.sum("size").cast("bigint").alias("size"),
        F.try_divide(F.sum(F.col("size") * F.col("price")), F.sum("size")).alias("avg_price"),
        F.max_by("price", F.struct(F.col(ts), F.col("event_id"))).alias("current_price"),
    )


def position_summary(positions: DataFrame, account: str = "account") -> DataFrame:
    """O1: invested ``sum(size * avg_price)``, unrealised P&L and its percentage."""
    g = positions.groupBy(account).agg(
        F.sum(F.col("size") * F.col("avg_price")).alias("total_invested"),
        F.sum(F.col("size") * (F.col("current_price") - F.col("avg_price"))).alias("unrealized_pnl"),
        F.count(F.lit(1)).alias("positions"),
    )
    return g.withColumn("unrealized_pct", F.when(F.col("total_invested") > 0,
                                                 F.col("unrealized_pnl") / F.col("total_invested") * 100.0)
                        .otherwise(F.lit(0.0)))


def signed_positions(positions: DataFrame) -> DataFrame:
    """O2: size signed by side (YES +, NO -)."""
    return positions.withColumn("signed_size", F.when(F.col("side") == "yes", F.col("size"))
                                .otherwise(-F.col("size")).cast("bigint"))


def pnl_statistics(daily_pnl: DataFrame, account: str = "account", capital: float = 10_000.0) -> DataFrame:
    """O3: total (last cumulative), daily mean, best and worst day, total as % of capital."""
    g = daily_pnl.groupBy(account).agg(
        F.max_by("cumulative_pnl", "date").alias("total_pnl"),
        F.avg("daily_pnl").alias("daily_avg"),
        F.max("daily_pnl").alias("best_day"),
        F.min("daily_pnl").alias("worst_day"),
    )
    return g.withColumn("total_pct", F.col("total_pnl") / capital * 100.0)


def trade_statistics(trades: DataFrame, account: str = "account") -> DataFrame:
    """Trade count, win rate %, profit factor (mean win / |mean loss|, 0
    without losses) and total volume (sum of sizes)."""
    g = trades.groupBy(account).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.sum((F.col("pnl") > 0).cast("int")).alias("_wins"),
        F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("_avg_win"),
        F.avg(F.when(F.col("pnl") < 0, F.col("pnl"))).alias("_avg_loss"),
        F.sum("size").cast("bigint").alias("total_volume"),
    )
    loss = F.abs(F.col("_avg_loss"))
    pf = F.when(loss > 0, F.col("_avg_win") / loss).otherwise(F.lit(0.0))
    return g.select(account, "total_trades",
                    F.when(F.col("total_trades") > 0, F.col("_wins") / F.col("total_trades") * 100.0)
                    .otherwise(F.lit(0.0)).alias("win_rate_pct"),
                    F.coalesce(pf, F.lit(0.0)).alias("profit_factor"), "total_volume")


def _book_order(market: str):
    """Book order per side: bids by price descending, asks ascending, then arrival."""
    key = F.when(F.col("side") == "bid", -F.col("price_cents")).otherwise(F.col("price_cents"))
    return Window.partitionBy(market, "side").orderBy(key, F.col("event_id"))


def book_depth(book: DataFrame, market: str = "market") -> DataFrame:
    """Cumulative size per side in book order; cents to dollars.

    Sizes are summed per price level first; only the levels of a side (at most
    one per cent) are ordered together, and orders within their own level."""
    level = [market, "side", "price_cents"]
    best = F.when(F.col("side") == "bid", -F.col("price_cents")).otherwise(F.col("price_cents"))
    levels = book.groupBy(*level).agg(F.sum("size").alias("_level"))
    upto = F.sum("_level").over(Window.partitionBy(market, "side").orderBy(best)
                                .rowsBetween(Window.unboundedPreceding, 0))
    before = levels.select(*level, (upto - F.col("_level")).alias("_before"))
    inside = F.sum("size").over(Window.partitionBy(*level).orderBy("event_id")
                                .rowsBetween(Window.unboundedPreceding, 0))
    return book.join(before, level).select(
        market, "side", "event_id", (F.col("price_cents") / 100.0).alias("price"), "size",
        (F.col("_before") + inside).alias("cumulative_size"))


def top_of_book(book: DataFrame, market: str = "market", levels: int = 5) -> DataFrame:
    """The best ``levels`` levels per side (a top-k report)."""
    w = _book_order(market)
    return (book.withColumn("level", F.row_number().over(w)).where(F.col("level") <= levels)
            .select(market, "side", "level", (F.col("price_cents") / 100.0).alias("price"), "size"))


def spread(book: DataFrame, market: str = "market") -> DataFrame:
    """Best bid, best ask and spread (0 if a side is missing) per market."""
    g = book.groupBy(market).agg(
        F.max(F.when(F.col("side") == "bid", F.col("price_cents"))).alias("_bid"),
        F.min(F.when(F.col("side") == "ask", F.col("price_cents"))).alias("_ask"),
    )
    bid = F.col("_bid") / 100.0
    ask = F.col("_ask") / 100.0
    return g.select(market, bid.alias("best_bid"), ask.alias("best_ask"),
                    F.coalesce(ask - bid, F.lit(0.0)).alias("spread"))


def equity_direction(curve: DataFrame, key: str = "account", date: str = "date", equity: str = "equity") -> DataFrame:
    """First and last equity per key and whether it ended up or down."""
    g = curve.groupBy(key).agg(F.min_by(equity, date).alias("start_equity"),
                               F.max_by(equity, date).alias("end_equity"))
    return g.withColumn("direction", F.when(F.col("end_equity") >= F.col("start_equity"), F.lit("up"))
                        .otherwise(F.lit("down")))
