"""Calendar dimension: weekday/month flags, US federal holidays, seasons.

Holidays come from rules (fixed dates with weekend observance, n-th and last
weekdays) evaluated per year. The dimension is one row per day over the
covered years — bounded by the calendar, not by the data volume — so it is
safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# US federal holidays as (name, month, day) for fixed dates and
# (name, month, weekday, n) for n-th weekday rules (n = -1: last), with the
# first year each rule applies.
FIXED_HOLIDAYS = (
    ("New Year's Day", 1, 1, 1871),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 1871),
    ("Veterans Day", 11, 11, 1938),
    ("Christmas Day", 12, 25, 1871),
)
WEEKDAY_HOLIDAYS = (
    ("Martin Luther King Jr. Day", 1, "Mon", 3, 1986),
    ("Washington's Birthday", 2, "Mon", 3, 1971),
    ("Memorial Day", 5, "Mon", -1, 1971),
    ("Labor Day", 9, "Mon", 1, 1894),
    ("Columbus Day", 10, "Mon", 2, 1971),
    ("Thanksgiving", 11, "Thu", 4, 1942),
)
SUMMER_MONTHS = (6, 7, 8)
WINTER_MONTHS = (12, 1, 2)


def _observed(d: Column) -> Column:
    """Saturday holidays are observed on Friday, Sunday holidays on Monday."""
    wd = F.weekday(d)  # Monday = 0
    return F.when(wd == 5, F.date_sub(d, 1)).when(wd == 6, F.date_add(d, 1))


def _nth_weekday(y: Column, month: int, dow: str, n: int) -> Column:
    if n > 0:
        first = F.next_day(F.date_sub(F.make_date(y, F.lit(month), F.lit(1)), 1), dow)
        return F.date_add(first, 7 * (n - 1))
    last_day = F.last_day(F.make_date(y, F.lit(month), F.lit(1)))
    return F.date_sub(F.next_day(last_day, dow), 7)


def holidays(years: DataFrame) -> DataFrame:
    """``(holiday_date, name)`` for every year in ``years(year INT)``; observed days included."""
    y = F.col("year")
    parts = []
    for name, m, d, since in FIXED_HOLIDAYS:
        actual = F.make_date(y, F.lit(m), F.lit(d))
        parts.append(F.when(y >= since, F.array(
            F.struct(actual.alias("holiday_date"), F.lit(name).alias("name")),
            F.struct(_observed(actual).alias("holiday_date"), F.lit(f"{name} (observed)").alias("name")),
        )))
    for name, m, dow, n, since in WEEKDAY_HOLIDAYS:
        parts.append(F.when(y >= since, F.array(
            F.struct(_nth_weekday(y, m, dow, n).alias("holiday_date"), F.lit(name).alias("name")))))
    arr = F.flatten(F.filter(F.array(*parts), lambda a: a.isNotNull()))
    out = years.select(F.explode(arr).alias("h")).select("h.holiday_date", "h.name")
    return out.where(F.col("holiday_date").isNotNull())


def calendar_dim(dates: DataFrame, date: str = "date") -> DataFrame:
    """D1-D5 for each distinct date of ``dates``.

    Holidays are generated for the years spanned plus one, so "days to the
    next holiday" always finds one (365 only if the rules produce none).
    """
    days = dates.select(F.col(date).alias("date")).distinct()
    bounds = days.agg(F.year(F.min("date")).alias("lo"), F.year(F.max("date")).alias("hi"))
    years = bounds.select(F.explode(F.sequence("lo", F.col("hi") + 1)).alias("year"))
    hol = holidays(years).select("holiday_date").distinct()
    return _attach(days, hol)


def _attach(days: DataFrame, hol: DataFrame) -> DataFrame:
    """Flag holidays and count days to the next strictly later one.

    The range condition ``holiday > date`` is bucketed by year: each day meets
    only its own and the next year's holidays (about 25 rows), an equi-join
    on the bucket plus a filter, never a cross product.
    """
    hol = F.broadcast(hol.select("holiday_date", F.year("holiday_date").alias("_y")))
    dd = days.select("date", F.explode(F.array(F.year("date"), F.year("date") + 1)).alias("_y"))
    nxt = (dd.join(hol, "_y").where(F.col("holiday_date") > F.col("date"))
           .groupBy("date").agg(F.min("holiday_date").alias("_nh")))
    flag = hol.select(F.col("holiday_date").alias("date"), F.lit(1).alias("_hol"))
    x = days.join(nxt, "date", "left").join(flag, "date", "left")
    return x.select(
        "date",
        F.weekday("date").alias("day_of_week"),
        F.dayofmonth("date").alias("day_of_month"),
        F.month("date").alias("month"),
        F.weekday("date").isin(5, 6).cast("int").alias("is_weekend"),
        F.coalesce(F.col("_hol"), F.lit(0)).alias("is_holiday"),
        F.coalesce(F.datediff("_nh", "date"), F.lit(365)).alias("days_to_holiday"),
        F.month("date").isin(*SUMMER_MONTHS).cast("int").alias("is_summer"),
        F.month("date").isin(*WINTER_MONTHS).cast("int").alias("is_winter"),
        (~F.month("date").isin(*(SUMMER_MONTHS + WINTER_MONTHS))).cast("int").alias("is_shoulder_season"),
    )


def with_calendar(df: DataFrame, date: str = "date", first_year: int = 1900, last_year: int = 2200) -> DataFrame:
    """D1-D5 as columns of ``df``, without another look at its dates.

    The holidays of ``first_year`` to ``last_year`` are one small map from a year to
    its dates, a scalar of the plan; a row looks only at its own and the next year's.
    """
    years = df.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    days = holidays(years).select("holiday_date").distinct()
    lists = days.groupBy(F.year("holiday_date").alias("y")).agg(F.array_sort(F.collect_list("holiday_date")).alias("d"))
    every = lists.agg(F.map_from_entries(F.collect_list(F.struct("y", "d"))).alias("m")).select("m").scalar()
    day, none = F.col(date), F.array().cast("array<date>")
    near = F.concat(*(F.coalesce(F.try_element_at(every, F.year(day) + k), none) for k in (0, 1)))
    x = df.withColumn("_near", near)
    later = F.get(F.filter("_near", lambda h: h > day), F.lit(0))
    month = F.month(day)
    return x.select(
        *df.columns, F.weekday(day).alias("day_of_week"), F.dayofmonth(day).alias("day_of_month"), month.alias("month"),
        F.weekday(day).isin(5, 6).cast("int").alias("is_weekend"), F.array_contains("_near", day).cast("int").alias("is_holiday"),
        F.coalesce(F.datediff(later, day), F.lit(365)).alias("days_to_holiday"),
        month.isin(*SUMMER_MONTHS).cast("int").alias("is_summer"), month.isin(*WINTER_MONTHS).cast("int").alias("is_winter"),
        (~month.isin(*(SUMMER_MONTHS + WINTER_MONTHS))).cast("int").alias("is_shoulder_season"))
