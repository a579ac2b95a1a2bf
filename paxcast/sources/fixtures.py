"""Deterministic input views derived from the driver tables.

Each view gives an operator family the table shape it expects (daily counts,
weather, fares, trades, returns, ...) while its size grows with the source
tables. The same derivations are written as SQL in
``paxcast.plans.oracle_views`` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paxcast.sources.tables import Tables


def _k(props: str = "props") -> Column:
    """Integer ``k`` carried in the events JSON text."""
    return F.get_json_object(F.col(props), "$.k").cast("int")


def daily_counts(t: Tables) -> DataFrame:
    """``(series, date, passengers)`` — one series per return flag."""
    return (
        t.lineitem.groupBy(
            F.col("l_returnflag").alias("series"),
            F.to_date("l_shipdate").alias("date"),
        ).agg((F.sum("l_quantity") * 1000.0).alias("passengers"))
    )


def weather(t: Tables) -> DataFrame:
    """``(airport, date, temperature, precipitation, snow, wind_speed)``."""
    e = t.events
    et = F.col("event_type")
    return e.groupBy(
        F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")).alias("airport"),
        F.to_date("ts").alias("date"),
    ).agg(
        F.avg(F.when(et != "error", F.col("value"))).alias("temperature"),
        F.avg(F.when(et == "view", F.col("value") / 100.0)).alias("precipitation"),
        F.avg(F.when((et == "purchase") & (F.col("value") > 150), F.col("value") / 1000.0)
              .otherwise(F.lit(0.0))).alias("snow"),
        F.avg(F.when(et != "click", _k().cast("double"))).alias("wind_speed"),
    )


def fares(t: Tables) -> DataFrame:
    """``(route, date, price, capacity)``, one row per line item."""
    li = t.lineitem
    return li.select(
        F.concat(F.lit("R"), (F.col("l_suppkey") % 20).cast("string")).alias("route"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("capacity"),
    )


def trades(t: Tables) -> DataFrame:
    """``(account, ts, contract, side, size, price, pnl)``."""
    e = t.events
    return e.select(
        F.concat(F.lit("U"), (F.col("user_id") % 5).cast("string")).alias("account"),
        F.col("ts"),
        F.col("event_id"),
        F.concat(F.lit("C"), (F.col("user_id") % 25).cast("string")).alias("contract"),
        F.when(F.col("event_id") % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("side"),
        (_k() + 1).cast("bigint").alias("size"),
        ((F.col("event_id") % 97 + 1) / 100.0).alias("price"),
        (F.col("value") - 50.0).alias("pnl"),
    )


def returns(t: Tables) -> DataFrame:
    """``(account, date, ret, position)`` from orders per customer bucket and day."""
    o = t.orders
    daily = o.groupBy(
        F.concat(F.lit("P"), (F.col("o_custkey") % 20).cast("string")).alias("account"),
        F.to_date("o_orderdate").alias("date"),
    ).agg(
        F.sum("o_totalprice").alias("amount"),
        F.sum(F.when(F.month("o_orderdate") % 2 == 0, 1).otherwise(-1)).cast("bigint").alias("position"),
    )
    w = Window.partitionBy("account").orderBy("date")
    prev = F.lag("amount").over(w)
    ret = F.coalesce(F.least(F.greatest(F.try_divide(F.col("amount"), prev) - 1.0, F.lit(-0.05)), F.lit(0.05)),
                     F.lit(0.0))
    return daily.select("account", "date", ret.alias("ret"), "position")


def model_predictions(t: Tables) -> DataFrame:
    """Long ``(series, date, model, pred, actual)`` from three simple forecasters."""
    d = daily_counts(t)
    w = Window.partitionBy("series").orderBy("date")
    w28 = w.rowsBetween(-28, -1)
    full = F.count("passengers").over(w28) == 28
    wide = d.select(
        "series", "date", F.col("passengers").alias("actual"),
        F.lag("passengers", 1).over(w).alias("naive"),
        F.lag("passengers", 7).over(w).alias("seasonal"),
        F.when(full, F.avg("passengers").over(w28)).alias("mean28"),
    )
    long = wide.select(
        "series", "date", "actual",
        F.expr("stack(3, 'naive', naive, 'seasonal', seasonal, 'mean28', mean28) as (model, pred)"),
    )
    return long.where(F.col("pred").isNotNull())


def causal_sample(t: Tables) -> DataFrame:
    """Per order date ``(date, volume, price, season, gdp, severity)``."""
    o = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    li = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    return (
        j.groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(
            F.sum("l_quantity").alias("volume"),
            F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.avg("o_totalprice").alias("gdp"),
            F.avg("l_discount").alias("severity"),
        )
        .withColumn("season", F.quarter("date").cast("bigint"))
    )


def order_book(t: Tables) -> DataFrame:
    """``(market, side, price_cents, size, event_id)`` quote levels."""
    e = t.events
    return e.select(
        F.concat(F.lit("M"), (F.col("user_id") % 10).cast("string")).alias("market"),
        F.when(F.col("event_id") % 2 == 0, F.lit("bid")).otherwise(F.lit("ask")).alias("side"),
        _k().cast("bigint").alias("price_cents"),
        F.col("value").cast("bigint").alias("size"),
        F.col("event_id"),
    )


def binary_forecasts(t: Tables) -> DataFrame:
    """``(event_id, date, prob, outcome, price)``."""
    e = t.events
    return e.select(
        "event_id",
        F.to_date("ts").alias("date"),
        ((_k() + 0.5) / 100.0).alias("prob"),
        F.col("event_type").isin("purchase", "signup").cast("bigint").alias("outcome"),
        ((F.col("event_id") % 97 + 1) / 100.0).alias("price"),
    )


def order_stream(t: Tables) -> DataFrame:
    """``(account, ts, event_id, size, price)`` candidate orders."""
    e = t.events
    return e.select(
        F.concat(F.lit("U"), (F.col("user_id") % 5).cast("string")).alias("account"),
        "ts", "event_id",
        (_k() + 1).cast("bigint").alias("size"),
        ((F.col("event_id") % 97 + 1) / 100.0).alias("price"),
    )


def quotes(ladder: DataFrame, week_no: str = "week_idx") -> DataFrame:
    """X4 quotes for a contract ladder: deterministic YES/NO prices and a
    market volume per ``(series, week_end, rung)``, standing in for the
    recorded quotes of a real market."""
    yes = ((F.col(week_no) * 7 + (F.col("rung") + 2) * 13) % 91 + 5) / 100.0
    return ladder.select(
        "*", yes.alias("yes_price"), (1.0 - yes).alias("no_price"),
        ((F.col(week_no) * 37) % 1500).cast("double").alias("volume"),
        (F.col("rung") + 3).alias("days_to_expiry"),
    )


def ledger_targets(t: Tables) -> DataFrame:
    """Daily target positions and prices per account for the ledger (N8):
    X7's signed order count as the target and a deterministic price."""
    r = returns(t)
    price = ((F.dayofyear("date") % 89) + 5) / 100.0
    return r.select("account", "date", F.col("position").alias("target"), price.alias("price"))
