"""Cleaning of counts, weather and fares.

Per-key statistics (means, percentiles, std, max) are computed with a
``groupBy`` — partial aggregation before the shuffle, so a hot airport or
route costs one buffer per task — and joined back on the key. AQE turns
that join into a broadcast at run time when the statistics table is small
and keeps a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paxcast.functions.stats import full_frame


def with_prior_year(daily: DataFrame, key: str = "series", date: str = "date",
                    value: str = "passengers") -> DataFrame:
    """Add ``{value}_prior_year``: the key's value on ``add_months(date, -12)``."""
    lookup = daily.select(F.col(key), F.col(date).alias("_prior_date"), F.col(value).alias(f"{value}_prior_year"))
    rows = daily.withColumn("_prior_date", F.add_months(F.col(date), -12))
    return rows.join(lookup, [key, "_prior_date"], "left").drop("_prior_date")


def process_counts(daily: DataFrame, key: str = "series", date: str = "date",
                   value: str = "passengers", prior: str | None = None) -> DataFrame:
    """C1 + C2: year-over-year growth and a 7-row trailing mean (null until 7 rows)."""
    if prior is None:
        daily = with_prior_year(daily, key, date, value)
        prior = f"{value}_prior_year"
    w = Window.partitionBy(key).orderBy(date)
    growth = F.try_divide(F.col(value) - F.col(prior), F.nullif(F.col(prior), F.lit(0.0)))
    return daily.select(
        "*", growth.alias("yoy_growth"),
        full_frame(F.avg, value, w, -6, 0).alias(f"{value}_7d_ma"),
    )


def process_weather(weather: DataFrame, key: str = "airport", quantile: float = 0.95,
                    approx: bool = False) -> DataFrame:
    """Fill gaps and flag extreme weather.

    Temperature and wind gaps take the airport mean; precipitation and snow
    gaps take 0. ``extreme_weather`` is precipitation or wind above the
    airport's linear-interpolated ``quantile`` (of the filled values), or any
    snow. ``approx=True`` uses a bounded-memory sketch for very large groups.
    """
    means = weather.groupBy(key).agg(F.avg("temperature").alias("_t_mean"), F.avg("wind_speed").alias("_w_mean"))
    filled = weather.join(means, key, "left").select(
        *[c for c in weather.columns if c not in ("temperature", "precipitation", "snow", "wind_speed")],
        F.coalesce("temperature", "_t_mean").alias("temperature"),
        F.coalesce("precipitation", F.lit(0.0)).alias("precipitation"),
        F.coalesce("snow", F.lit(0.0)).alias("snow"),
        F.coalesce("wind_speed", "_w_mean").alias("wind_speed"),
    )
    def pct(c):
        if approx:
            return F.percentile_approx(F.col(c), F.lit(quantile)).cast("double")
        return F.percentile(F.col(c), F.lit(quantile))

    q = filled.groupBy(key).agg(pct("precipitation").alias("_p_q"), pct("wind_speed").alias("_w_q"))
    extreme = (F.col("precipitation") > F.col("_p_q")) | (F.col("snow") > 0) | (F.col("wind_speed") > F.col("_w_q"))
    return filled.join(q, key, "left").withColumn("extreme_weather", F.coalesce(extreme, F.lit(False))) \
        .drop("_p_q", "_w_q")


def process_fares(fares: DataFrame, key: str = "route") -> DataFrame:
    """C6 + C7: per-route price z-score (sample std) and capacity utilisation."""
    stats = fares.groupBy(key).agg(
        F.avg("price").alias("_mu"), F.stddev_samp("price").alias("_sd"), F.max("capacity").alias("_cap")
    )
    j = fares.join(stats, key, "left")
    return j.select(
        *fares.columns,
        F.try_divide(F.col("price") - F.col("_mu"), F.nullif(F.col("_sd"), F.lit(0.0))).alias("price_zscore"),
        F.try_divide(F.col("capacity"), F.nullif(F.col("_cap"), F.lit(0.0))).alias("capacity_utilization"),
    )
