"""SQL text of the fixture views, for the DuckDB oracle.

These mirror ``paxcast.sources.fixtures`` one for one. DuckDB rounds on a
DOUBLE -> BIGINT cast where Spark truncates, so truncation is spelled out.
"""

X1 = """x1 AS (
  SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date,
         SUM(l_quantity) * 1000.0 AS passengers
  FROM lineitem GROUP BY 1, 2)"""

X2 = """x2 AS (
  SELECT 'A' || CAST(user_id % 10 AS VARCHAR) AS airport, CAST(ts AS DATE) AS date,
         AVG(CASE WHEN event_type <> 'error' THEN value END) AS temperature,
         AVG(CASE WHEN event_type = 'view' THEN value / 100.0 END) AS precipitation,
         AVG(CASE WHEN event_type = 'purchase' AND value > 150 THEN value / 1000.0 ELSE 0.0 END) AS snow,
         AVG(CASE WHEN event_type <> 'click' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END) AS wind_speed
  FROM events GROUP BY 1, 2)"""

X3 = """x3 AS (
  SELECT 'R' || CAST(l_suppkey % 20 AS VARCHAR) AS route, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS price, l_quantity AS capacity
  FROM lineitem)"""

X6 = """x6 AS (
  SELECT 'U' || CAST(user_id % 5 AS VARCHAR) AS account, ts, event_id,
         'C' || CAST(user_id % 25 AS VARCHAR) AS contract,
         CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS BIGINT) AS size,
         (event_id % 97 + 1) / 100.0 AS price,
         value - 50.0 AS pnl
  FROM events)"""

X7 = """x7_daily AS (
  SELECT 'P' || CAST(o_custkey % 20 AS VARCHAR) AS account, CAST(o_orderdate AS DATE) AS date,
         SUM(o_totalprice) AS amount,
         CAST(SUM(CASE WHEN month(o_orderdate) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS position
  FROM orders GROUP BY 1, 2),
x7 AS (
  SELECT account, date,
         COALESCE(LEAST(GREATEST(amount / NULLIF(LAG(amount) OVER (PARTITION BY account ORDER BY date), 0) - 1.0,
                                 -0.05), 0.05), 0.0) AS ret,
         position
  FROM x7_daily)"""

X8 = X1 + """,
x8_wide AS (
  SELECT series, date, passengers AS actual,
         LAG(passengers, 1) OVER w AS naive,
         LAG(passengers, 7) OVER w AS seasonal,
         CASE WHEN COUNT(passengers) OVER w28 = 28 THEN AVG(passengers) OVER w28 END AS mean28
  FROM x1
  WINDOW w AS (PARTITION BY series ORDER BY date),
         w28 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
x8 AS (
  SELECT series, date, actual, 'naive' AS model, naive AS pred FROM x8_wide WHERE naive IS NOT NULL
  UNION ALL SELECT series, date, actual, 'seasonal', seasonal FROM x8_wide WHERE seasonal IS NOT NULL
  UNION ALL SELECT series, date, actual, 'mean28', mean28 FROM x8_wide WHERE mean28 IS NOT NULL)"""

X9 = """x9 AS (
  SELECT CAST(o_orderdate AS DATE) AS date, SUM(l_quantity) AS volume,
         AVG(l_extendedprice / l_quantity) AS price, AVG(o_totalprice) AS gdp,
         AVG(l_discount) AS severity, CAST(quarter(CAST(o_orderdate AS DATE)) AS BIGINT) AS season
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"""

X12 = """x12 AS (
  SELECT 'M' || CAST(user_id % 10 AS VARCHAR) AS market,
         CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS BIGINT) AS price_cents,
         CAST(trunc(value) AS BIGINT) AS size, event_id
  FROM events)"""

X13 = """x13 AS (
  SELECT event_id, CAST(ts AS DATE) AS date,
         (CAST(json_extract_string(props, '$.k') AS INTEGER) + 0.5) / 100.0 AS prob,
         CAST(event_type IN ('purchase', 'signup') AS BIGINT) AS outcome,
         (event_id % 97 + 1) / 100.0 AS price
  FROM events)"""

X14 = """x14 AS (
  SELECT 'U' || CAST(user_id % 5 AS VARCHAR) AS account, ts, event_id,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS BIGINT) AS size,
         (event_id % 97 + 1) / 100.0 AS price
  FROM events)"""


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def gram_sql(source: str, keys: str, columns: list[str], extra: str = "") -> str:
    """SELECT of the cross-product matrix of a constant and ``columns``, as a flat list."""
    named = ["1.0", *(f"CAST({c} AS DOUBLE)" for c in columns)]
    cells = ", ".join(f"SUM({named[min(i, j)]} * {named[max(i, j)]})" for i in range(len(named)) for j in range(len(named)))
    return f"SELECT {keys}, COUNT(*) AS n_rows, [{cells}] AS g{extra} FROM {source} GROUP BY {keys}"


def sweep_sql(name: str, source: str, keys: str, m: int, pivots: str) -> str:
    """A CTE ``name`` with ``keys`` and ``s``, the matrix ``g`` of ``source`` swept on the
    positions of the list ``pivots``, one recursive step per position."""
    step = f"""list_transform(g, lambda v, x: CASE
        WHEN NOT (g[p * {m} + p + 1] > 1e-9 * g0[p * {m} + p + 1]) THEN v
        WHEN (x - 1) // {m} = p AND (x - 1) % {m} = p THEN -1.0 / v
        WHEN (x - 1) // {m} = p OR (x - 1) % {m} = p THEN v / g[p * {m} + p + 1]
        ELSE v - g[((x - 1) // {m}) * {m} + p + 1] * g[p * {m} + (x - 1) % {m} + 1] / g[p * {m} + p + 1] END)"""
    return f"""{name} AS (
  WITH RECURSIVE r AS (
    SELECT {keys}, g, g AS g0, {pivots} AS todo FROM {source}
    UNION ALL
    SELECT {keys}, {step} AS g, g0, todo FROM (SELECT *, old[1] AS p, old[2:] AS todo FROM (SELECT * EXCLUDE (todo), todo AS old FROM r) q WHERE len(old) > 0) q2)
  SELECT {keys}, g AS s FROM r WHERE len(todo) = 0)"""


def coefficient_sql(p: int, y: int, m: int) -> str:
    return f"(CASE WHEN s[{p * m + p + 1}] < 0 THEN s[{p * m + y + 1}] ELSE 0.0 END)"
