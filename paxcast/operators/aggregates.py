"""Per-date weather and fare aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weather_features(processed_weather: DataFrame, date: str = "date") -> DataFrame:
    """E1 + E2: per date severe-airport count, mean temperature, max wind,
    total precipitation and a severity index.

    The index divides by the maximum over the whole result; that maximum is a
    scalar subquery (evaluated once, inlined as a value), not a join.
    """
    e1 = processed_weather.groupBy(date).agg(
        F.sum(F.col("extreme_weather").cast("int")).cast("bigint").alias("severe_weather_airports"),
        F.avg("temperature").alias("avg_temperature"),
        F.max("wind_speed").alias("max_wind_speed"),
        F.sum("precipitation").alias("total_precipitation"),
    )
    # Both maxima in one scalar subquery (one pass over the per-date table).
    mx = e1.select(F.struct(F.max("max_wind_speed").alias("w"), F.max("total_precipitation").alias("p"))).scalar()
    sev = (F.col("severe_weather_airports") * 0.4
           + F.try_divide(F.col("max_wind_speed"), F.nullif(mx["w"], F.lit(0.0))) * 0.3
           + F.try_divide(F.col("total_precipitation"), F.nullif(mx["p"], F.lit(0.0))) * 0.3)
    return e1.withColumn("weather_severity_index", sev)


def airline_features(processed_fares: DataFrame, date: str = "date") -> DataFrame:
    """Per date mean price, std of price z-scores, total capacity, mean utilisation."""
    return processed_fares.groupBy(date).agg(
        F.avg("price").alias("avg_price"),
        F.stddev_samp("price_zscore").alias("price_volatility"),
        F.sum("capacity").alias("total_capacity"),
        F.avg("capacity_utilization").alias("avg_capacity_utilization"),
    )


def fare_features(fares: DataFrame, key: str = "route", date: str = "date") -> DataFrame:
    """C6, C7 and E3 from unprocessed fares in one pass: counts, sums and squares per
    (route, date) hold all that the routes' z-scores and utilisations add up to."""
    p, c = F.col("price").cast("double"), F.col("capacity").cast("double")
    g = fares.groupBy(key, date).agg(
        F.count(p).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"), F.count(c).alias("cn"), F.sum(c).alias("cs"), F.max(c).alias("cm"))
    route = Window.partitionBy(key)  # one row per day of the route
    g = g.withColumn("_total", F.sum("n").over(route)).withColumn("_mu", F.try_divide(F.sum("s").over(route), F.col("_total")))
    squares = F.sum("q").over(route) - F.col("_total") * F.col("_mu") * F.col("_mu")
    # What rounding leaves of a route of equal prices is no spread.
    sd = F.when((F.col("_total") > 1) & (squares > 1e-12 * F.sum("q").over(route)), F.sqrt(squares / (F.col("_total") - 1)))
    g = g.withColumn("_sd", sd).withColumn("_cap", F.nullif(F.max("cm").over(route), F.lit(0.0)))
    z, scored = (F.col("s") - F.col("n") * F.col("_mu")) / F.col("_sd"), F.when(F.col("_sd").isNotNull(), F.col("n"))
    z2 = (F.col("q") - 2 * F.col("_mu") * F.col("s") + F.col("n") * F.col("_mu") * F.col("_mu")) / (F.col("_sd") * F.col("_sd"))
    d = g.groupBy(date).agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("avg_price"), F.sum(z).alias("_z"), F.sum(z2).alias("_z2"), F.sum(scored).alias("_n"),
        F.sum("cs").alias("total_capacity"),
        F.try_divide(F.sum(F.col("cs") / F.col("_cap")), F.sum(F.when(F.col("_cap").isNotNull(), F.col("cn")))).alias("avg_capacity_utilization"))
    spread = F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.col("_z2") - F.col("_z") * F.col("_z") / F.col("_n"), F.lit(0.0)) / (F.col("_n") - 1)))
    return d.select(date, "avg_price", spread.alias("price_volatility"), "total_capacity", "avg_capacity_utilization")
