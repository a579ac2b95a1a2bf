"""Queries: page, weather and market parsing; extract de-duplication,
coverage and freshness (S1-S5, S8-S14).

The documents are rendered by Spark from the driver tables (their size grows
with them), then parsed back; the oracle states the expected rows in SQL
directly from the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paxcast.plans.oracle_views import X1, X2, X3, with_
from paxcast.plans.q_forecast import FORECAST_SQL
from paxcast.plans.q_signals import STEP, contracts_x4, x4_sql
from paxcast.plans.registry import query, round_doubles, round_sql
from paxcast.sources import fixtures, parsers
from paxcast.sources.tables import Tables

# ---------------------------------------------------------------- S1, S2


@query("count_pages", "S1 S2", round_sql(with_(X1) + "SELECT series, date, passengers FROM x1", ["passengers"]))
def q_count_pages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rendered = parsers.render_count_pages(fixtures.daily_counts(t)).select("series", "html")
    # Raw web pages without a count table: parsed too, and must yield nothing.
    raw = t.pages.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("series"), "html")
    return round_doubles(parsers.parse_count_pages(rendered.unionByName(raw)))


# ---------------------------------------------------------------- S5

S5_START, S5_END = "1993-01-01", "1997-12-31"
DEDUPE_SQL = f"""
WITH ex AS (
  SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date,
         CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS ingest_seq, SUM(l_quantity) * 1000.0 AS passengers
  FROM lineitem GROUP BY 1, 2, 3)
SELECT series, date, arg_max(passengers, ingest_seq) AS passengers FROM ex
WHERE date BETWEEN DATE '{S5_START}' AND DATE '{S5_END}' GROUP BY 1, 2"""


@query("dedupe_extracts", "S5", round_sql(DEDUPE_SQL, ["passengers"]))
def q_dedupe(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # The range as bounds on the raw timestamp as well, so it reaches the
    # Parquet scan (a filter on to_date(...) cannot be pushed).
    li = t.lineitem.where((F.col("l_shipdate") >= F.lit(S5_START).cast("timestamp_ntz"))
                          & (F.col("l_shipdate") < F.date_add(F.lit(S5_END), 1).cast("timestamp_ntz")))
    ex = li.groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("date"),
                    F.when(F.col("l_linestatus") == "F", 2).otherwise(1).alias("ingest_seq")) \
        .agg((F.sum("l_quantity") * 1000.0).alias("passengers"))
    return round_doubles(parsers.dedupe_extracts(ex, start=S5_START, end=S5_END))


# ---------------------------------------------------------------- S8, S9

REQ_START, REQ_END, NOW = "1992-06-01", "1998-08-01", "1998-12-02 12:00:00"
COVERAGE_SQL = with_(X1) + f"""
SELECT series, MIN(date) AS min_date, MAX(date) AS max_date, MAX(CAST(date AS TIMESTAMP) + INTERVAL 1 DAY)
         AS last_ingested,
       MIN(date) <= DATE '{REQ_START}' AND MAX(date) >= DATE '{REQ_END}' - 2 AS covers_range,
       MAX(CAST(date AS TIMESTAMP) + INTERVAL 1 DAY) >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AS is_fresh,
       (MIN(date) <= DATE '{REQ_START}' AND MAX(date) >= DATE '{REQ_END}' - 2)
         AND MAX(CAST(date AS TIMESTAMP) + INTERVAL 1 DAY) >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AS use_stored
FROM x1 GROUP BY 1"""


@query("coverage_check", "S8", COVERAGE_SQL)
def q_coverage(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = fixtures.daily_counts(t)
    d = d.withColumn("ingested_at", (F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")))
    return parsers.coverage(d, REQ_START, REQ_END, NOW)


TODAY = "1998-12-03"
FRESH_SQL = with_(X1, X2, X3) + f""",
latest AS (SELECT 'tsa' AS source, MAX(date) AS latest_date FROM x1
           UNION ALL SELECT 'weather', MAX(date) FROM x2
           UNION ALL SELECT 'fares', MAX(date) FROM x3),
names(source) AS (VALUES ('tsa'), ('weather'), ('fares'), ('economic'))
SELECT n.source, l.latest_date, CAST(DATE '{TODAY}' - l.latest_date AS INTEGER) AS days_old,
       CASE WHEN l.latest_date IS NULL THEN 'unavailable'
            WHEN DATE '{TODAY}' - l.latest_date <= 2 THEN 'fresh' ELSE 'stale' END AS status
FROM names n LEFT JOIN latest l ON n.source = l.source"""


@query("data_freshness", "S9", FRESH_SQL)
def q_freshness(spark, sf_dir):
    t = Tables(spark, sf_dir)
    latest = (fixtures.daily_counts(t).agg(F.max("date").alias("latest_date")).select(F.lit("tsa").alias("source"),
                                                                                     "latest_date")
              .unionByName(fixtures.weather(t).agg(F.max("date").alias("latest_date"))
                           .select(F.lit("weather").alias("source"), "latest_date"))
              .unionByName(fixtures.fares(t).agg(F.max("date").alias("latest_date"))
                           .select(F.lit("fares").alias("source"), "latest_date")))
    return parsers.freshness(latest, ["tsa", "weather", "fares", "economic"], TODAY)


# ---------------------------------------------------------------- S3, S4

def _explicit_nulls():
    """Airports whose feed writes explicit JSON nulls (the rest omit the key)."""
    return F.col("airport").isin("A5", "A6", "A7", "A8", "A9")


def _render_weather(t: Tables, kind: str):
    w = fixtures.weather(t)
    ts = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")
    if kind == "obs":
        props = F.struct(
            ts.alias("timestamp"),
            F.struct(F.col("temperature").alias("value")).alias("temperature"),
            F.struct(F.col("snow").alias("value")).alias("dewpoint"),
            F.struct(F.col("wind_speed").alias("value")).alias("windSpeed"),
            F.when(F.col("precipitation").isNotNull(), F.struct(F.col("precipitation").alias("value")))
            .alias("precipitationLastHour"),
            F.when(F.col("temperature") > 50, F.lit("Warm")).when(F.col("temperature").isNotNull(), F.lit("Cool"))
            .alias("textDescription"),
        )
        item = F.struct(F.col("date"), F.struct(props.alias("properties")).alias("f"))
    else:
        speed = F.concat(F.coalesce(F.rint("wind_speed").cast("bigint"), F.lit(0)).cast("string"), F.lit(" mph"))
        period = F.struct(
            ts.alias("startTime"), F.col("temperature").alias("temperature"), speed.alias("windSpeed"),
            F.lit("NW").alias("windDirection"), F.lit("Sunny").alias("shortForecast"),
            F.when(F.col("precipitation").isNotNull(),
                   F.struct(F.rint(F.col("precipitation") * 100.0).alias("value"))).alias("probabilityOfPrecipitation"),
        )
        item = F.struct(F.col("date"), period.alias("f"))
    # One document per airport and month: a bounded group (at most 31 days).
    g = w.groupBy("airport", F.date_trunc("month", "date").alias("month"), _explicit_nulls().alias("_nulls")) \
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
    arr = F.transform("_items", lambda s: s["f"])
    wrapped = F.struct(arr.alias("features")) if kind == "obs" else \
        F.struct(F.struct(arr.alias("periods")).alias("properties"))
    keep = F.to_json(wrapped, {"ignoreNullFields": "false"})
    drop = F.to_json(wrapped)
    return g.select("airport", F.when(F.col("_nulls"), keep).otherwise(drop).alias("json"))


OBS_SQL = with_(X2) + """
SELECT airport, CAST(date AS TIMESTAMP) AS timestamp, temperature * 9.0 / 5.0 + 32.0 AS temperature,
       snow * 9.0 / 5.0 + 32.0 AS dewpoint, wind_speed * 2.237 AS wind_speed,
       CAST(NULL AS DOUBLE) AS wind_direction, CAST(NULL AS DOUBLE) AS humidity,
       CASE WHEN precipitation IS NOT NULL THEN precipitation
            WHEN airport IN ('A5', 'A6', 'A7', 'A8', 'A9') THEN NULL ELSE 0.0 END AS precipitation_last_hour,
       CASE WHEN temperature > 50 THEN 'Warm' WHEN temperature IS NOT NULL THEN 'Cool'
            WHEN airport IN ('A5', 'A6', 'A7', 'A8', 'A9') THEN NULL ELSE '' END AS description
FROM x2"""


@query("weather_observations", "S3", round_sql(OBS_SQL, ["temperature", "dewpoint", "wind_speed", "wind_direction",
                                                         "humidity", "precipitation_last_hour"]))
def q_weather_observations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(parsers.parse_observations(_render_weather(t, "obs")))


FORECAST_PERIODS_SQL = with_(X2) + """
SELECT airport, CAST(date AS TIMESTAMP) AS timestamp, temperature,
       CAST(COALESCE(CAST(round_even(wind_speed, 0) AS BIGINT), 0) AS DOUBLE) AS wind_speed,
       'NW' AS wind_direction, 'Sunny' AS description,
       COALESCE(round_even(precipitation * 100.0, 0), 0.0) AS precipitation_probability
FROM x2"""


@query("weather_forecast_periods", "S4", round_sql(FORECAST_PERIODS_SQL, ["temperature", "wind_speed",
                                                                          "precipitation_probability"]))
def q_weather_forecast(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(parsers.parse_forecast(_render_weather(t, "fc")))


# ---------------------------------------------------------------- S10-S14

PREFIX = "KXTSAW"


def _render_markets(t: Tables):
    c = contracts_x4(t)
    ev = F.concat(F.lit(PREFIX), F.col("series"), F.lit("-"), F.upper(F.date_format("week_end", "yyMMMdd")))
    millions = F.format_string("%.2f", F.col("threshold") / 1e6)
    suffix = (F.when(F.col("rung") < 0, F.concat(F.lit("-B"), millions))
              .when(F.col("rung") == 0, F.concat(F.lit("-A"), millions))
              .otherwise(F.concat(F.lit("-T"), F.col("threshold").cast("string"))))
    cents = F.rint(F.col("yes_price") * 100.0).cast("bigint")
    m = F.struct(
        F.concat(ev, suffix).alias("ticker"),
        F.when(F.col("rung") == 0, F.concat(F.lit("M-"), ev)).alias("market_id"),
        F.when(F.col("yes_price") > 0.5, F.lit("open")).otherwise(F.lit("closed")).alias("status"),
        (cents - 1).alias("yes_bid"), (cents + 1).alias("yes_ask"),
        (99 - cents).alias("no_bid"), (101 - cents).alias("no_ask"),
        cents.alias("last_price"),
        F.when(F.col("rung") % 2 == 0, cents).alias("previous_price"),
    )
    # One document per event (five rungs): a bounded group.
    g = c.groupBy("series", ev.alias("event_ticker")).agg(F.array_sort(F.collect_list(
        F.struct(F.col("rung"), m.alias("m")))).alias("_ms"))
    return g.select("series", "event_ticker",
                    F.to_json(F.struct(F.transform("_ms", lambda s: s["m"]).alias("markets"))).alias("json"))


MARKETS_CTE = x4_sql(FORECAST_SQL, STEP) + f""",
mk AS (
  SELECT series, '{PREFIX}' || series || '-' || upper(strftime(week_end, '%y%b%d')) AS event_ticker, rung, threshold,
         CAST(round_even(yes_price * 100.0, 0) AS BIGINT) AS cents, yes_price
  FROM x4),
mk2 AS (
  SELECT *, event_ticker || CASE WHEN rung < 0 THEN '-B' || printf('%.2f', threshold / 1e6)
                                 WHEN rung = 0 THEN '-A' || printf('%.2f', threshold / 1e6)
                                 ELSE '-T' || CAST(threshold AS VARCHAR) END AS ticker,
         CASE WHEN yes_price > 0.5 THEN 'open' ELSE 'closed' END AS status
  FROM mk)"""

MARKETS_SQL = with_(MARKETS_CTE) + """
SELECT * FROM (
  SELECT event_ticker, ticker, CASE WHEN rung = 0 THEN 'M-' || event_ticker ELSE ticker END AS market_id, status,
         (cents - 1) / 100.0 AS yes_bid, (cents + 1) / 100.0 AS yes_ask, (99 - cents) / 100.0 AS no_bid,
         (101 - cents) / 100.0 AS no_ask, cents / 100.0 AS last_price,
         CASE WHEN rung % 2 = 0 THEN cents / 100.0 END AS previous_price,
         CAST(CASE WHEN regexp_extract(ticker, '-A(\\d+\\.?\\d*)', 1) <> ''
                   THEN trunc(TRY_CAST(regexp_extract(ticker, '-A(\\d+\\.?\\d*)', 1) AS DOUBLE) * 1e6)
                   WHEN regexp_extract(ticker, '-B(\\d+\\.\\d+)', 1) <> ''
                   THEN trunc(TRY_CAST(regexp_extract(ticker, '-B(\\d+\\.\\d+)', 1) AS DOUBLE) * 1e6)
                   WHEN regexp_extract(ticker, '-T(\\d+)', 1) <> '' THEN TRY_CAST(regexp_extract(ticker, '-T(\\d+)', 1) AS BIGINT)
                   WHEN regexp_extract(ticker, '-B(\\d+)', 1) <> '' THEN TRY_CAST(regexp_extract(ticker, '-B(\\d+)', 1) AS BIGINT)
                   ELSE 0 END AS BIGINT) AS threshold,
         (cents - 1) / 100.0 AS yes_price, (99 - cents) / 100.0 AS no_price
  FROM mk2) z WHERE threshold > 0"""

MARKET_DOUBLES = ["yes_bid", "yes_ask", "no_bid", "no_ask", "last_price", "previous_price", "yes_price", "no_price"]


@query("market_contracts", "S10 S11 S14", round_sql(MARKETS_SQL, MARKET_DOUBLES))
def q_market_contracts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = parsers.parse_markets(_render_markets(t))
    return round_doubles(parsers.contracts_from_markets(m))


CURRENT_SQL = with_(MARKETS_CTE, """ev AS (
  SELECT series, event_ticker, MAX(CAST(status IN ('open', 'active') AS INTEGER)) AS has_open,
         CAST(strptime('20' || split_part(event_ticker, '-', 2), '%Y%b%d') AS DATE) AS event_date
  FROM mk2 GROUP BY series, event_ticker),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY event_date DESC NULLS LAST, event_ticker DESC) AS r
       FROM ev)""") + """
SELECT series, arg_max(event_ticker, (has_open, -r)) AS event_ticker, arg_max(event_date, (has_open, -r)) AS event_date,
       CAST(arg_max(has_open, (has_open, -r)) AS INTEGER) AS has_open_market
FROM rk WHERE r <= 5 GROUP BY 1"""


@query("current_event", "S12 S13", CURRENT_SQL)
def q_current_event(spark, sf_dir):
    t = Tables(spark, sf_dir)
    docs = _render_markets(t)
    markets = parsers.parse_markets(docs, keep=("series", "event_ticker"))
    events = docs.select("series", "event_ticker")
    return parsers.current_event(events, markets, PREFIX)
