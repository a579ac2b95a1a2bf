"""Queries: causal effects over the daily sample and the graph reports
(K1-K7). One graph is the fixed causal dimension, the other an edge table learnt
from the sample; paths, adjustment sets and fits of all measured pairs are
rows of one plan. The effects read the order and line-item tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paxcast.operators import causal
from paxcast.plans.oracle_views import X9, gram_sql, sweep_sql, with_
from paxcast.plans.registry import query, round_doubles, round_sql
from paxcast.session import materialise
from paxcast.sources import fixtures
from paxcast.sources.tables import Tables

# Which sample column measures which graph node (fixed by the sample view).
NODE_COLUMNS = {
    "tsa_volume": "volume",
    "airline_prices": "price",
    "weather_severity": "severity",
    "season": "season",
    "gdp": "gdp",
    "day_of_week": "day_of_week",
}
# Levels of the measured columns that control as categories (fixed by the calendar).
CATEGORICAL = {"season": [1, 2, 3, 4], "day_of_week": [0, 1, 2, 3, 4, 5, 6]}
NUMERIC = list(NODE_COLUMNS)


def _sample(t: Tables):
    s = fixtures.causal_sample(t).withColumn("day_of_week", F.weekday("date").cast("bigint"))
    return s.select(*[F.col(c).alias(n) for n, c in NODE_COLUMNS.items()])


def effects(sample, edges):
    """Effects of every measured pair that the graph joins, under its adjustment set."""
    return causal.ols_effects(sample, causal.adjustment_sets(edges), NUMERIC, CATEGORICAL)


SAMPLE_SQL = with_(X9) + """,
smp AS (SELECT volume AS tsa_volume, price AS airline_prices, severity AS weather_severity, season, gdp,
               CAST(isodow(date) - 1 AS BIGINT) AS day_of_week FROM x9)"""
SAMPLE_CTE = SAMPLE_SQL.replace("WITH ", "", 1)


def _effects_sql() -> str:
    """CTEs from ``edges`` and ``smp`` to ``eff``: paths, sets, matrix, sweeps."""
    dummy = {c: [f"CASE WHEN {c} = {v} THEN 1.0 ELSE 0.0 END" for v in levels[1:]] for c, levels in CATEGORICAL.items()}
    columns = [*NUMERIC, *(d for ds in dummy.values() for d in ds)]
    m = len(columns) + 1
    own = "MAP {" + ", ".join(f"'{c}': {i}" for i, c in enumerate(NUMERIC, 1)) + "}"
    places = {c: [i] for i, c in enumerate(NUMERIC, 1)}
    at = len(NUMERIC) + 1
    for c, ds in dummy.items():
        places[c], at = list(range(at, at + len(ds))), at + len(ds)
    control = "MAP {" + ", ".join(f"'{c}': {v}" for c, v in places.items()) + "}"
    measured = "(" + ", ".join(f"'{c}'" for c in NUMERIC) + ")"
    complete = " AND ".join(f"{c} IS NOT NULL" for c in NUMERIC)
    return f"""paths AS (
  WITH RECURSIVE r(src, dst, path) AS (
    SELECT DISTINCT src, dst, [src, dst] FROM edges WHERE src <> dst
    UNION ALL
    SELECT r.src, e.dst, list_append(r.path, e.dst) FROM r JOIN (SELECT DISTINCT src, dst FROM edges) e ON r.dst = e.src
    WHERE NOT list_contains(r.path, e.dst))
  SELECT * FROM r),
doors AS (
  SELECT DISTINCT e.dst AS cause, p.dst AS effect, unnest(p.path) AS node FROM paths p JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = p.src
  WHERE p.dst <> e.dst AND NOT list_contains(p.path, e.dst)),
sets AS (SELECT cause, effect, list(node ORDER BY node) AS nodes FROM doors WHERE node <> effect AND node IN {measured} GROUP BY 1, 2),
pairs AS (
  SELECT DISTINCT p.src AS cause, p.dst AS effect, coalesce(s.nodes, []) AS controls FROM paths p LEFT JOIN sets s ON s.cause = p.src AND s.effect = p.dst
  WHERE p.src IN {measured} AND p.dst IN {measured}),
matrix AS ({gram_sql(f"(SELECT 1 AS one, * FROM smp WHERE {complete}) z", "one", columns)}),
fits AS (SELECT cause, effect, controls, n_rows, g, {own}[cause] AS c, {own}[effect] AS e,
                list_concat([0, {own}[cause]], flatten(list_transform(controls, lambda k: {control}[k]))) AS places FROM pairs, matrix),
{sweep_sql("swept", "fits", "cause, effect", m, "places")},
eff AS (
  SELECT cause, effect, beta AS effect_estimate, se AS std_err, {causal._t_pvalue('tstat', 'dof')} AS p_value,
         beta - {causal._t_quantile('dof')} * se AS conf_int_lower, beta + {causal._t_quantile('dof')} * se AS conf_int_upper,
         1.0 - ssr / sst AS r_squared, n_obs, controls
  FROM (SELECT *, beta / se AS tstat FROM (SELECT *, sqrt(ssr / dof * factor) AS se FROM (
    SELECT f.cause, f.effect, n_rows AS n_obs, array_to_string(controls, ',') AS controls, CASE WHEN s[c * {m} + c + 1] < 0 THEN s[c * {m} + e + 1] END AS beta,
           -s[c * {m} + c + 1] AS factor, s[e * {m} + e + 1] AS ssr, g[e * {m} + e + 1] - g[e + 1] * g[e + 1] / n_rows AS sst,
           CAST(n_rows - len(list_filter(places, lambda k: s[k * {m} + k + 1] < 0)) AS DOUBLE) AS dof
    FROM fits f JOIN swept w ON w.cause = f.cause AND w.effect = f.effect) a) b) z)"""


EFFECTS_CTE = _effects_sql()
EFFECT_COLS = ["effect_estimate", "std_err", "p_value", "conf_int_lower", "conf_int_upper", "r_squared"]


def _graph_sql() -> str:
    nodes = ", ".join(f"('{n}', '{ty}')" for n, _name, ty in causal.NODES)
    edges = ", ".join(f"('{s}', '{d}', '{st}', {lag})" for s, d, st, lag in causal.EDGES)
    return (f"nodes(node, type) AS (VALUES {nodes}),\n"
            f"edges(src, dst, strength, lag) AS (VALUES {edges})")


@query("causal_effects", "K3 K4 K5", round_sql(with_(SAMPLE_CTE, _graph_sql(), EFFECTS_CTE) + "SELECT * FROM eff", EFFECT_COLS, 4))
def q_causal_effects(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(effects(_sample(t), causal.edges_df(spark)), 4)


# The learnt graph: columns in causal order, and how many edges it has.
CAUSAL_ORDER = ["season", "day_of_week", "gdp", "airline_prices", "weather_severity", "tsa_volume"]
LEARNT_EDGES = 9
_PAIRS = [(a, b) for i, a in enumerate(CAUSAL_ORDER) for b in CAUSAL_ORDER[i + 1:]]
LEARNT_SQL = ("edges AS (SELECT src, dst FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS src, '{b}' AS dst, abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) AS weight FROM smp" for a, b in _PAIRS)
    + f") z ORDER BY weight DESC, src, dst LIMIT {LEARNT_EDGES})")


@query("causal_learnt_graph", "K1 K3 K4 K5", round_sql(with_(SAMPLE_CTE, LEARNT_SQL, EFFECTS_CTE) + "SELECT * FROM eff", EFFECT_COLS, 4))
def q_causal_learnt_graph(spark, sf_dir):
    sample = materialise(_sample(Tables(spark, sf_dir)), "sample")  # read for the edges and for the fits
    return round_doubles(effects(sample, causal.correlated_edges(sample, CAUSAL_ORDER, LEARNT_EDGES)), 4)


TRADING_SQL = with_(SAMPLE_CTE, _graph_sql(), EFFECTS_CTE) + f"""
SELECT e.src AS factor, e.strength, CAST(e.lag AS INTEGER) AS lag, COALESCE(abs(f.effect_estimate), 0.0) AS effect_size
FROM edges e LEFT JOIN eff f ON f.cause = e.src AND f.effect = e.dst WHERE e.dst = '{causal.TARGET}'"""


@query("causal_trading_factors", "K6", round_sql(TRADING_SQL, ["effect_size"], 4))
def q_causal_trading_factors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(causal.trading_factors(causal.edges_df(spark), effects(_sample(t), causal.edges_df(spark))), 4) \
        .withColumn("lag", F.col("lag").cast("int"))


RISK_SQL = with_(SAMPLE_CTE, _graph_sql(), EFFECTS_CTE) + f""",
reach AS (SELECT src, dst FROM (
  WITH RECURSIVE r(src, dst, path) AS (
    SELECT src, dst, [src, dst] FROM edges
    UNION ALL
    SELECT r.src, e.dst, list_append(r.path, e.dst) FROM r JOIN edges e ON r.dst = e.src
    WHERE NOT list_contains(r.path, e.dst))
  SELECT DISTINCT src, dst FROM r) z),
desc_ AS (SELECT src, COUNT(*) AS n_effects FROM reach GROUP BY 1)
SELECT n.node AS factor, n.type, CAST(COALESCE(d.n_effects, 0) AS BIGINT) AS n_effects,
       COALESCE(abs(f.effect_estimate), 0.0) AS effect_size
FROM nodes n LEFT JOIN desc_ d ON n.node = d.src
LEFT JOIN eff f ON f.cause = n.node AND f.effect = '{causal.TARGET}'
WHERE n.type <> 'target'"""


@query("causal_risk_factors", "K1 K2 K7", round_sql(RISK_SQL, ["effect_size"], 4))
def q_causal_risk_factors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return round_doubles(causal.risk_factors(causal.nodes_df(spark), causal.edges_df(spark), effects(_sample(t), causal.edges_df(spark))), 4)
