"""Queries: cleaning, calendar, per-date aggregates, lags, point-in-time
access and latest values (C1-C7, D1-D5, E1-E3, F1-F4, G1-G4, H2, H3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paxcast.operators import aggregates, calendar, clean, features, pit, resample
from paxcast.plans.oracle_views import X1, X2, X3, X6, with_
from paxcast.plans.registry import query, round_doubles, round_sql
from paxcast.sources import fixtures
from paxcast.sources.tables import Tables

# ---------------------------------------------------------------- C1, C2

COUNTS_SQL = with_(X1) + """
SELECT a.series, a.date, a.passengers, p.passengers AS passengers_prior_year,
       (a.passengers - p.passengers) / NULLIF(p.passengers, 0) AS yoy_growth,
       CASE WHEN COUNT(a.passengers) OVER w = 7 THEN AVG(a.passengers) OVER w END AS passengers_7d_ma
FROM x1 a LEFT JOIN x1 p ON a.series = p.series AND p.date = CAST(a.date - INTERVAL 12 MONTH AS DATE)
WINDOW w AS (PARTITION BY a.series ORDER BY a.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""


@query("process_counts", "C1 C2",
       round_sql(COUNTS_SQL, ["passengers", "passengers_prior_year", "yoy_growth", "passengers_7d_ma"]))
def q_process_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(clean.process_counts(fixtures.daily_counts(t)))


# ---------------------------------------------------------------- C3-C5

WEATHER_SQL = """filled AS (
  SELECT x2.airport, date,
         COALESCE(temperature, AVG(temperature) OVER (PARTITION BY x2.airport)) AS temperature,
         COALESCE(precipitation, 0.0) AS precipitation,
         COALESCE(snow, 0.0) AS snow,
         COALESCE(wind_speed, AVG(wind_speed) OVER (PARTITION BY x2.airport)) AS wind_speed
  FROM x2),
q AS (
  SELECT airport, quantile_cont(precipitation, 0.95) AS p_q, quantile_cont(wind_speed, 0.95) AS w_q
  FROM filled GROUP BY 1),
pw AS (
  SELECT f.airport, f.date, f.temperature, f.precipitation, f.snow, f.wind_speed,
         COALESCE(f.precipitation > q.p_q OR f.snow > 0 OR f.wind_speed > q.w_q, FALSE) AS extreme_weather
  FROM filled f LEFT JOIN q ON f.airport = q.airport)"""

WEATHER_COLS = ["temperature", "precipitation", "snow", "wind_speed"]


@query("process_weather", "C3 C4 C5", round_sql(with_(X2, WEATHER_SQL) + "SELECT * FROM pw", WEATHER_COLS))
def q_process_weather(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(clean.process_weather(fixtures.weather(t)))


# ---------------------------------------------------------------- C6, C7

FARES_SQL = """pf AS (
  SELECT route, date, price, capacity,
         (price - AVG(price) OVER r) / NULLIF(STDDEV_SAMP(price) OVER r, 0) AS price_zscore,
         capacity / NULLIF(MAX(capacity) OVER r, 0) AS capacity_utilization
  FROM x3 WINDOW r AS (PARTITION BY route))"""


@query("process_fares", "C6 C7", round_sql(with_(X3, FARES_SQL) + "SELECT * FROM pf",
                                           ["price", "capacity", "price_zscore", "capacity_utilization"]))
def q_process_fares(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(clean.process_fares(fixtures.fares(t)))


# ---------------------------------------------------------------- D1-D5

_ISO = {"Mon": 1, "Tue": 2, "Wed": 3, "Thu": 4, "Fri": 5, "Sat": 6, "Sun": 7}


def _holiday_sql() -> str:
    parts = []
    for _name, m, d, since in calendar.FIXED_HOLIDAYS:
        h = f"make_date(y, {m}, {d})"
        parts.append(f"SELECT {h} AS hd FROM years WHERE y >= {since}")
        parts.append(f"SELECT CASE isodow({h}) WHEN 6 THEN {h} - 1 WHEN 7 THEN {h} + 1 END FROM years "
                     f"WHERE y >= {since} AND isodow({h}) IN (6, 7)")
    for _name, m, dow, n, since in calendar.WEEKDAY_HOLIDAYS:
        iso = _ISO[dow]
        if n > 0:
            first = f"make_date(y, {m}, 1)"
            h = f"{first} + CAST(({iso} - isodow({first}) + 7) % 7 + {7 * (n - 1)} AS INTEGER)"
        else:
            last = f"CAST(last_day(make_date(y, {m}, 1)) AS DATE)"
            h = f"{last} - CAST((isodow({last}) - {iso} + 7) % 7 AS INTEGER)"
        parts.append(f"SELECT {h} FROM years WHERE y >= {since}")
    return "\n  UNION ".join(parts)


CAL_CTES = f"""days AS (SELECT DISTINCT date FROM x1),
years AS (SELECT unnest(generate_series(year(MIN(date)), year(MAX(date)) + 1)) AS y FROM days),
hol AS (
  {_holiday_sql()}),
nxt AS (SELECT d.date, MIN(h.hd) AS nh FROM days d JOIN hol h ON h.hd > d.date GROUP BY 1),
cal AS (
SELECT d.date,
       CAST(isodow(d.date) - 1 AS BIGINT) AS day_of_week, CAST(day(d.date) AS BIGINT) AS day_of_month,
       CAST(month(d.date) AS BIGINT) AS month,
       CAST(isodow(d.date) IN (6, 7) AS BIGINT) AS is_weekend,
       CAST(d.date IN (SELECT hd FROM hol) AS BIGINT) AS is_holiday,
       CAST(COALESCE(n.nh - d.date, 365) AS BIGINT) AS days_to_holiday,
       CAST(month(d.date) IN (6, 7, 8) AS BIGINT) AS is_summer,
       CAST(month(d.date) IN (12, 1, 2) AS BIGINT) AS is_winter,
       CAST(month(d.date) NOT IN (6, 7, 8, 12, 1, 2) AS BIGINT) AS is_shoulder_season
FROM days d LEFT JOIN nxt n ON d.date = n.date)"""

CALENDAR_SQL = with_(X1, CAL_CTES) + "SELECT * FROM cal"


@query("calendar_features", "D1 D2 D3 D4 D5", CALENDAR_SQL)
def q_calendar_features(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(calendar.calendar_dim(fixtures.daily_counts(t).select("date")))


# ---------------------------------------------------------------- E1-E3

WF_SQL = """e1 AS (
  SELECT date, CAST(SUM(CAST(extreme_weather AS INTEGER)) AS BIGINT) AS severe_weather_airports,
         AVG(temperature) AS avg_temperature, MAX(wind_speed) AS max_wind_speed,
         SUM(precipitation) AS total_precipitation
  FROM pw GROUP BY 1),
wf AS (
  SELECT *, severe_weather_airports * 0.4
            + max_wind_speed / NULLIF((SELECT MAX(max_wind_speed) FROM e1), 0) * 0.3
            + total_precipitation / NULLIF((SELECT MAX(total_precipitation) FROM e1), 0) * 0.3
            AS weather_severity_index
  FROM e1)"""
WF_COLS = ["avg_temperature", "max_wind_speed", "total_precipitation", "weather_severity_index"]


@query("weather_features", "E1 E2", round_sql(with_(X2, WEATHER_SQL, WF_SQL) + "SELECT * FROM wf", WF_COLS))
def q_weather_features(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(aggregates.weather_features(clean.process_weather(fixtures.weather(t))))


AF_SQL = """af AS (
  SELECT date, AVG(price) AS avg_price, STDDEV_SAMP(price_zscore) AS price_volatility,
         SUM(capacity) AS total_capacity, AVG(capacity_utilization) AS avg_capacity_utilization
  FROM pf GROUP BY 1)"""
AF_COLS = ["avg_price", "price_volatility", "total_capacity", "avg_capacity_utilization"]


@query("airline_features", "E3", round_sql(with_(X3, FARES_SQL, AF_SQL) + "SELECT * FROM af", AF_COLS))
def q_airline_features(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(aggregates.airline_features(clean.process_fares(fixtures.fares(t))))


# ---------------------------------------------------------------- F1-F4

LAGS = (1, 7, 14, 28)
LAG_COLS = [f"passengers_lag_{k}" for k in LAGS]
LAG_SQL = with_(X1) + "SELECT series, date, passengers, " + ", ".join(
    f"LAG(passengers, {k}) OVER w AS passengers_lag_{k}" for k in LAGS
) + "\nFROM x1 WINDOW w AS (PARTITION BY series ORDER BY date)"


@query("lag_features", "F1", round_sql(LAG_SQL, ["passengers", *LAG_COLS]))
def q_lag_features(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(features.lag_features(fixtures.daily_counts(t), ("passengers",), LAGS))


LAGGED_SQL = ("lagged AS (SELECT series, date, passengers, "
              + ", ".join(f"LAG(passengers, {k}) OVER w AS passengers_lag_{k}" for k in LAGS)
              + " FROM x1 WINDOW w AS (PARTITION BY series ORDER BY date))")
FM_SQL = with_(X1, CAL_CTES, X2, WEATHER_SQL, WF_SQL, X3, FARES_SQL, AF_SQL, LAGGED_SQL) + """
SELECT l.*, c.* EXCLUDE (date), wf.* EXCLUDE (date), af.* EXCLUDE (date)
FROM lagged l LEFT JOIN cal c ON l.date = c.date LEFT JOIN wf ON l.date = wf.date
LEFT JOIN af ON l.date = af.date"""


@query("feature_matrix", "F2", round_sql(FM_SQL, ["passengers", *LAG_COLS, *WF_COLS, *AF_COLS], 6))
def q_feature_matrix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    fm = features.feature_matrix(
        fixtures.daily_counts(t),
        processed_weather=clean.process_weather(fixtures.weather(t)),
        fares=fixtures.fares(t),
        lags=LAGS,
    )
    return round_doubles(fm, 6)


TM_SQL = with_(X1) + """
SELECT * FROM (
  SELECT series, date, passengers AS target,
         CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, CAST(month(date) AS BIGINT) AS month,
         CAST(isodow(date) IN (6, 7) AS BIGINT) AS is_weekend,
         LAG(passengers, 1) OVER w AS lag_1, LAG(passengers, 7) OVER w AS lag_7,
         CASE WHEN COUNT(passengers) OVER r = 7 THEN AVG(passengers) OVER r END AS rolling_mean_7,
         CASE WHEN COUNT(passengers) OVER r = 7 THEN STDDEV_SAMP(passengers) OVER r END AS rolling_std_7
  FROM x1
  WINDOW w AS (PARTITION BY series ORDER BY date),
         r AS (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) t
WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND rolling_mean_7 IS NOT NULL AND rolling_std_7 IS NOT NULL"""


@query("training_matrix", "F3",
       round_sql(TM_SQL, ["target", "lag_1", "lag_7", "rolling_mean_7", "rolling_std_7"]))
def q_training_matrix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(features.training_matrix(fixtures.daily_counts(t)))


PF_SQL = with_(X1) + """
SELECT series, date, CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, CAST(month(date) AS BIGINT) AS month,
       CAST(weekofyear(date) AS BIGINT) AS week_of_year,
       AVG(passengers) OVER r AS recent_mean, STDDEV_SAMP(passengers) OVER r AS recent_std
FROM x1 WINDOW r AS (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


@query("point_features", "F4", round_sql(PF_SQL, ["recent_mean", "recent_std"]))
def q_point_features(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(features.point_features(fixtures.daily_counts(t)))


# ---------------------------------------------------------------- G1-G4

# Fixed values of the query (not of the library): which event type stands
# for which source, and the reference time of the point-in-time questions.
EVENT_SOURCE = {"view": "tsa", "click": "weather", "purchase": "airlines", "signup": "hotels", "error": "economic"}
REFERENCE_TIME = "2024-01-20 12:00:00"


def _typed_events(t: Tables):
    m = F.create_map(*[x for kv in EVENT_SOURCE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return t.events.select("event_id", F.col("ts").alias("timestamp"), m[F.col("event_type")].alias("data_type"),
                           "value")


def _delays_sql() -> str:
    rows = ", ".join(f"('{k}', {v})" for k, v in sorted(pit.DATA_DELAYS_HOURS.items()))
    src = ", ".join(f"('{k}', '{v}')" for k, v in EVENT_SOURCE.items())
    return (f"delays(data_type, delay_hours) AS (VALUES {rows}),\n"
            f"srcmap(event_type, data_type) AS (VALUES {src}),\n"
            "typed AS (SELECT event_id, ts AS timestamp, s.data_type, value FROM events e "
            "JOIN srcmap s ON e.event_type = s.event_type)")


AVAIL_SQL = with_(_delays_sql()) + f"""
SELECT t.* FROM typed t JOIN delays d ON t.data_type = d.data_type
WHERE t.timestamp + d.delay_hours * INTERVAL 1 HOUR <= TIMESTAMP '{REFERENCE_TIME}'"""


@query("available_data", "G1", round_sql(AVAIL_SQL, ["value"]))
def q_available_data(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(pit.available_by_type(_typed_events(t), REFERENCE_TIME))


LATEST_SQL = with_(_delays_sql()) + f"""
SELECT d.data_type, TIMESTAMP '{REFERENCE_TIME}' - d.delay_hours * INTERVAL 1 HOUR AS latest_available,
       MAX(t.timestamp) FILTER (WHERE t.timestamp <= TIMESTAMP '{REFERENCE_TIME}' - d.delay_hours * INTERVAL 1 HOUR)
         AS latest_row, CAST(COUNT(t.event_id) AS BIGINT) AS rows_total
FROM delays d JOIN typed t ON t.data_type = d.data_type GROUP BY d.data_type, d.delay_hours"""


@query("latest_available", "G2", LATEST_SQL)
def q_latest_available(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return pit.latest_available_for(_typed_events(t), REFERENCE_TIME)


TIMELINE_FEATURES = {"tsa": "timestamp", "weather": "timestamp", "economic": "timestamp"}
TIMELINE_SQL = with_(_delays_sql()) + f"""
SELECT d.data_type, bool_and(t.timestamp + d.delay_hours * INTERVAL 1 HOUR <= TIMESTAMP '{REFERENCE_TIME}') AS valid,
       CAST(SUM(CAST(t.timestamp + d.delay_hours * INTERVAL 1 HOUR > TIMESTAMP '{REFERENCE_TIME}' AS INTEGER))
            AS BIGINT) AS violations,
       CAST(COUNT(*) AS BIGINT) AS rows
FROM typed t, delays d WHERE d.data_type IN ({", ".join(f"'{k}'" for k in TIMELINE_FEATURES)})
GROUP BY d.data_type"""


@query("validate_timeline", "G3", TIMELINE_SQL)
def q_validate_timeline(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return pit.validate_timeline(_typed_events(t), TIMELINE_FEATURES, REFERENCE_TIME)


ASOF_SQL = """
WITH c AS (SELECT 'A' || CAST(user_id % 10 AS VARCHAR) AS airport, ts AS cutoff FROM events
           WHERE event_type = 'purchase'),
     f AS (SELECT 'A' || CAST(user_id % 10 AS VARCHAR) AS airport, ts, value FROM events WHERE event_type = 'view')
SELECT c.airport, c.cutoff, f.ts AS asof_time, f.value
FROM c ASOF LEFT JOIN f ON c.airport = f.airport AND c.cutoff >= f.ts"""


@query("asof_latest_view", "G4", round_sql(ASOF_SQL, ["value"]))
def q_asof(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = t.events.select(F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")).alias("airport"),
                        "ts", "event_type", "value")
    cut = e.where(F.col("event_type") == "purchase").select("airport", F.col("ts").alias("cutoff"))
    facts = e.where(F.col("event_type") == "view").select("airport", "ts", "value")
    return round_doubles(pit.asof_join(cut, facts, "airport", "cutoff", "ts", ["value"]))


# ---------------------------------------------------------------- H2, H3

LATEST_VALUE_SQL = with_(X1) + """
SELECT l.series, l.date, l.value, p.passengers AS prior_value,
       CASE WHEN l.value > 0 THEN (l.value - p.passengers) / NULLIF(p.passengers, 0) END AS yoy_change
FROM (SELECT series, MAX(date) AS date, arg_max(passengers, date) AS value FROM x1 GROUP BY 1) l
LEFT JOIN x1 p ON p.series = l.series AND p.date = CAST(l.date - INTERVAL 12 MONTH AS DATE)"""


@query("latest_value", "H2", round_sql(LATEST_VALUE_SQL, ["value", "prior_value", "yoy_change"]))
def q_latest_value(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(resample.latest_value(fixtures.daily_counts(t)).drop("prior_date"))


DAILY_PNL_SQL = with_(X6) + """,
per_day AS (SELECT account, CAST(ts AS DATE) AS date, SUM(pnl) AS pnl FROM x6 GROUP BY 1, 2),
bounds AS (SELECT account, MIN(date) AS lo, MAX(date) AS hi FROM per_day GROUP BY 1),
spine AS (SELECT account, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
dense AS (SELECT s.account, s.date, COALESCE(p.pnl, 0.0) AS daily_pnl
          FROM spine s LEFT JOIN per_day p ON s.account = p.account AND s.date = p.date)
SELECT account, date, daily_pnl,
       SUM(daily_pnl) OVER (PARTITION BY account ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative_pnl
FROM dense"""


@query("daily_pnl", "H3", round_sql(DAILY_PNL_SQL, ["daily_pnl", "cumulative_pnl"]))
def q_daily_pnl(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(resample.daily_pnl(fixtures.trades(t)))
