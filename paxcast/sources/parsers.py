"""Parsers and source-side operators.

Raw documents (HTML count pages, observation / forecast JSON, market JSON)
arrive as rows of a table; parsing is expression work on each row
(``regexp_extract_all``, ``from_json``, ``explode``), so documents are
spread over tasks like any other rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- S1, S2: count pages --------------------------------------------------------

TABLE_RE = r"(?is)<table\b.*?</table>"
ROW_RE = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL_RE = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd", "MM/dd/yyyy")


def parse_number(text: Column) -> Column:
    """``"2,345,678"`` -> 2345678.0; junk -> null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def parse_date(text: Column) -> Column:
    """First date format that parses, else null."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_date(t, f) for f in DATE_FORMATS])


def cell_text(cell: Column) -> Column:
    """Text of a table cell: inner tags go, the character references that occur
    in counts and dates are decoded, white space (no-break included) is trimmed."""
    t = F.regexp_replace(cell, r"(?s)<!--.*?-->|<[^>]*>", "")
    t = F.regexp_replace(t, r"(?i)&nbsp;?|&#160;?|&#xa0;?", " ")
    for ref, char in (("&#44;", ","), ("&comma;", ","), ("&#47;", "/"), ("&sol;", "/"), ("&amp;", "&")):
        t = F.replace(t, F.lit(ref), F.lit(char))
    return F.regexp_replace(t, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def parse_count_pages(pages: DataFrame, keep=("series",), html: str = "html") -> DataFrame:
    """Rows of the first ``<table>`` of each page as ``(date, passengers)``.

    Pages without a table give no rows; rows whose first cell is not a date
    (headers, junk) are dropped; counts that do not parse are null.
    """
    table = F.regexp_extract(F.col(html), TABLE_RE, 0)
    x = pages.select(*keep, F.explode(F.regexp_extract_all(table, F.lit(ROW_RE), F.lit(1))).alias("_row"))
    x = x.select(*keep, F.regexp_extract_all(F.col("_row"), F.lit(CELL_RE), F.lit(1)).alias("_cells"))
    x = x.where(F.size("_cells") >= 2)
    x = x.select(*keep, parse_date(cell_text(F.col("_cells")[0])).alias("date"),
                 parse_number(cell_text(F.col("_cells")[1])).alias("passengers"))
    return x.where(F.col("date").isNotNull())


def render_count_pages(daily: DataFrame, key: str = "series") -> DataFrame:
    """One HTML page per (key, year) with a comma-grouped count table (the
    form the count pages are published in, with markup and references inside
    some cells). A page holds at most one year of days, so each group is
    bounded by the calendar."""
    number = F.format_number(F.col("passengers"), 0)
    kind = F.dayofmonth("date") % 4
    date = F.concat(F.date_format("date", "M/d/yyyy"), F.when(kind == 1, "&nbsp;").otherwise(""))
    count = F.when(kind == 0, number).when(kind == 1, F.concat(F.lit("<b>"), number, F.lit("</b>"))) \
        .when(kind == 2, F.concat(F.lit("\n  <span class=\"n\">"), number, F.lit("</span>&#160;"))) \
        .otherwise(F.replace(number, F.lit(","), F.lit("&#44;")))
    row = F.concat(F.lit("<tr><td>"), date, F.lit("</td><td align=right>"), count, F.lit("</td></tr>"))
    g = daily.groupBy(F.col(key), F.year("date").alias("year")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("date"), row.alias("r")))).alias("_rows"))
    body = F.array_join(F.transform("_rows", lambda s: s["r"]), "")
    html = F.concat(F.lit("<html><body><h1>Checkpoint numbers</h1><table><tr><th>Date</th><th>Numbers</th></tr>"),
                    body, F.lit("</table></body></html>"))
    return g.select(key, "year", html.alias("html"))


# --- S5: union of extracts -----------------------------------------------------------

def dedupe_extracts(extracts: DataFrame, key: str = "series", date: str = "date", seq: str = "ingest_seq",
                    start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per (key, date), the latest extract winning, inside an
    inclusive date range (the range filter is pushed to the scan)."""
    x = extracts
    if start is not None:
        x = x.where(F.col(date) >= F.to_date(F.lit(start)))
    if end is not None:
        x = x.where(F.col(date) <= F.to_date(F.lit(end)))
    others = [c for c in x.columns if c not in (key, date, seq)]
    g = x.groupBy(key, date).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_v"))
    return g.select(key, date, *[F.col(f"_v.{c}").alias(c) for c in others])


# --- S8, S9: coverage and freshness ---------------------------------------------

def coverage(df: DataFrame, start: str, end: str, now: str, key: str = "series", date: str = "date",
             ingested: str = "ingested_at", end_slack_days: int = 2, max_age_days: int = 1) -> DataFrame:
    """Does the stored range cover the request (min <= start and max >=
    end - 2 days) and is the latest ingest at most a day old."""
    g = df.groupBy(key).agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"),
                            F.max(ingested).alias("last_ingested"))
    now_ts = F.lit(dt.datetime.fromisoformat(now)).cast("timestamp_ntz")
    covers = (F.col("min_date") <= F.to_date(F.lit(start))) & \
             (F.col("max_date") >= F.date_sub(F.to_date(F.lit(end)), end_slack_days))
    fresh = F.col("last_ingested") >= now_ts - F.make_dt_interval(days=F.lit(max_age_days))
    return g.select("*", covers.alias("covers_range"), fresh.alias("is_fresh"),
                    (covers & fresh).alias("use_stored"))


def freshness(latest: DataFrame, sources: list[str], today: str, source: str = "source",
              latest_col: str = "latest_date", fresh_days: int = 2) -> DataFrame:
    """Latest date, days old and fresh (<= 2 days) / stale / unavailable
    per expected source; ``latest`` holds one row per source with data."""
    spark = latest.sparkSession
    names = spark.createDataFrame([(s,) for s in sources], f"{source} string")
    x = names.join(latest, source, "left")
    age = F.datediff(F.to_date(F.lit(today)), F.col(latest_col))
    status = F.when(F.col(latest_col).isNull(), F.lit("unavailable")) \
        .when(age <= fresh_days, F.lit("fresh")).otherwise(F.lit("stale"))
    return x.select(source, latest_col, age.alias("days_old"), status.alias("status"))


# --- S3, S4: weather JSON ---------------------------------------------------------

_VAL = T.StructType([T.StructField("value", T.DoubleType())])
OBS_PROPS = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("temperature", _VAL),
    T.StructField("dewpoint", _VAL),
    T.StructField("windSpeed", _VAL),
    T.StructField("windDirection", _VAL),
    T.StructField("relativeHumidity", _VAL),
    T.StructField("precipitationLastHour", _VAL),
    T.StructField("textDescription", T.StringType()),
])


def parse_observations(docs: DataFrame, keep=("airport",), body: str = "json") -> DataFrame:
    """S3: observation features -> flat rows; C -> F and m/s -> mph with
    nulls kept; precipitation 0 and description '' only when the key is
    absent (an explicit null stays null)."""
    feats = F.from_json(F.col(body), "struct<features: array<string>>")
    x = docs.select(*keep, F.explode(feats["features"]).alias("_f"))
    p = F.from_json(F.col("_f"), T.StructType([T.StructField("properties", OBS_PROPS)]))["properties"]
    # Key presence (an explicit null is present) from a map parse of the properties.
    keys = F.from_json(F.col("_f"), "struct<properties: map<string, string>>")["properties"]
    has_precip = F.map_contains_key(keys, "precipitationLastHour")
    has_text = F.map_contains_key(keys, "textDescription")
    return x.select(
        *keep,
        F.to_timestamp_ntz(p["timestamp"]).alias("timestamp"),
        (p["temperature"]["value"] * 9.0 / 5.0 + 32.0).alias("temperature"),
        (p["dewpoint"]["value"] * 9.0 / 5.0 + 32.0).alias("dewpoint"),
        (p["windSpeed"]["value"] * 2.237).alias("wind_speed"),
        p["windDirection"]["value"].alias("wind_direction"),
        p["relativeHumidity"]["value"].alias("humidity"),
        F.when(has_precip, p["precipitationLastHour"]["value"]).otherwise(F.lit(0.0)).alias("precipitation_last_hour"),
        F.when(has_text, p["textDescription"]).otherwise(F.lit("")).alias("description"),
    )


PERIOD = T.StructType([
    T.StructField("startTime", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("windSpeed", T.StringType()),
    T.StructField("windDirection", T.StringType()),
    T.StructField("shortForecast", T.StringType()),
    T.StructField("probabilityOfPrecipitation", _VAL),
])


def parse_forecast(docs: DataFrame, keep=("airport",), body: str = "json") -> DataFrame:
    """Hourly forecast periods; first token of ``"10 mph"`` as the wind
    speed; precipitation probability 0 when absent."""
    schema = T.StructType([T.StructField("properties", T.StructType([
        T.StructField("periods", T.ArrayType(PERIOD))]))])
    x = docs.select(*keep, F.explode(F.from_json(F.col(body), schema)["properties"]["periods"]).alias("p"))
    return x.select(
        *keep,
        F.to_timestamp_ntz(F.col("p.startTime")).alias("timestamp"),
        F.col("p.temperature").alias("temperature"),
        F.split(F.trim(F.col("p.windSpeed")), " ")[0].try_cast("double").alias("wind_speed"),
        F.col("p.windDirection").alias("wind_direction"),
        F.col("p.shortForecast").alias("description"),
        F.coalesce(F.col("p.probabilityOfPrecipitation.value"), F.lit(0.0)).alias("precipitation_probability"),
    )


# --- S10-S14: markets and events ----------------------------------------------

def ticker_threshold(ticker: Column) -> Column:
    """``-A2.80`` / ``-B2.15`` -> millions (truncated), ``-T17500000`` /
    ``-B17500000`` -> the digits, otherwise 0."""
    a = F.regexp_extract(ticker, r"-A(\d+\.?\d*)", 1)
    bdot = F.regexp_extract(ticker, r"-B(\d+\.\d+)", 1)
    t = F.regexp_extract(ticker, r"-T(\d+)", 1)
    b = F.regexp_extract(ticker, r"-B(\d+)", 1)
    millions = lambda s: (s.try_cast("double") * 1e6).cast("bigint")
    return (F.when(a != "", millions(a))
            .when(bdot != "", millions(bdot))
            .when(t != "", t.try_cast("bigint"))
            .when(b != "", b.try_cast("bigint"))
            .otherwise(F.lit(0).cast("bigint")))


def event_date(event_ticker: Column) -> Column:
    """``...-26JAN18`` -> 2026-01-18."""
    part = F.split(event_ticker, "-")[1]
    return F.try_to_date(F.concat(F.lit("20"), part), "yyyyMMMdd")


MARKET = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("market_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("yes_bid", T.LongType()),
    T.StructField("yes_ask", T.LongType()),
    T.StructField("no_bid", T.LongType()),
    T.StructField("no_ask", T.LongType()),
    T.StructField("last_price", T.LongType()),
    T.StructField("previous_price", T.LongType()),
])
CENT_FIELDS = ("yes_bid", "yes_ask", "no_bid", "no_ask", "last_price", "previous_price")


def parse_markets(docs: DataFrame, keep=("event_ticker",), body: str = "json") -> DataFrame:
    """Market rows with the six cent fields in dollars (null kept) and
    ``market_id`` falling back to the ticker."""
    schema = T.StructType([T.StructField("markets", T.ArrayType(MARKET))])
    x = docs.select(*keep, F.explode(F.from_json(F.col(body), schema)["markets"]).alias("m"))
    return x.select(*keep, F.col("m.ticker").alias("ticker"),
                    F.coalesce(F.col("m.market_id"), F.col("m.ticker")).alias("market_id"),
                    F.col("m.status").alias("status"),
                    *[(F.col(f"m.{c}") / 100.0).alias(c) for c in CENT_FIELDS])


def contracts_from_markets(markets: DataFrame) -> DataFrame:
    """Contracts with a positive threshold; YES/NO prices in dollars
    from the bids, 50 cents when missing."""
    x = markets.select("*", ticker_threshold(F.col("ticker")).alias("threshold"),
                       F.coalesce(F.col("yes_bid"), F.lit(0.5)).alias("yes_price"),
                       F.coalesce(F.col("no_bid"), F.lit(0.5)).alias("no_price"))
    return x.where(F.col("threshold") > 0)


def current_event(events: DataFrame, markets: DataFrame, prefix: str, group: str = "series",
                  newest: int = 5) -> DataFrame:
    """Per group, among the ``newest`` events (by ticker date) with the
    series prefix, the newest with an open or active market, else the newest.

    Market status is reduced per event first (one row per event), so the
    per-group ranking only sorts events.
    """
    ev = events.where(F.col("event_ticker").startswith(prefix)) \
        .withColumn("event_date", event_date(F.col("event_ticker")))
    has_open = markets.groupBy("event_ticker").agg(
        F.max(F.col("status").isin("open", "active").cast("int")).alias("has_open"))
    x = ev.join(has_open, "event_ticker", "left").withColumn("has_open", F.coalesce("has_open", F.lit(0)))
    w = Window.partitionBy(group).orderBy(F.col("event_date").desc_nulls_last(), F.col("event_ticker").desc())
    x = x.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= newest)
    pick = F.struct(F.col("has_open"), (-F.col("_rank")).alias("_r"))
    return x.groupBy(group).agg(F.max_by("event_ticker", pick).alias("event_ticker"),
                                F.max_by("event_date", pick).alias("event_date"),
                                F.max_by("has_open", pick).alias("has_open_market"))
