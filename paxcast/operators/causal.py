"""Causal graph and effect estimates (K1-K7).

The graph is an edge table. Paths are found by a recursive query, so the plan
is the same for any number of nodes; back-door paths and adjustment sets of
all (cause, effect) pairs come out of it as rows. Effects are least squares:
one aggregate of the full cross-product matrix over the data table serves
every pair, whose controls are just positions to sweep it on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paxcast.functions.stats import norm_cdf_sql
from paxcast.operators import regression
from paxcast.session import materialise

# The causal graph of passenger volume. Nodes as
# (id, name, type); edges as (cause, effect, strength, lag).
NODES = (
    ("tsa_volume", "TSA Passenger Volume", "target"),
    ("airline_prices", "Airline Ticket Prices", "price"),
    ("weather_severity", "Weather Severity", "external"),
    ("season", "Seasonal Effects", "temporal"),
    ("day_of_week", "Day of Week", "temporal"),
    ("holidays", "Holidays", "temporal"),
    ("gdp", "GDP", "economic"),
    ("employment", "Employment", "economic"),
    ("consumer_confidence", "Consumer Confidence", "economic"),
    ("hotel_prices", "Hotel Prices", "price"),
    ("business_travel", "Business Travel", "travel"),
    ("leisure_travel", "Leisure Travel", "travel"),
)
EDGES = (
    ("airline_prices", "tsa_volume", "strong", 1),
    ("weather_severity", "tsa_volume", "medium", 0),
    ("business_travel", "tsa_volume", "strong", 1),
    ("leisure_travel", "tsa_volume", "strong", 1),
    ("season", "leisure_travel", "strong", 0),
    ("season", "airline_prices", "medium", 1),
    ("holidays", "leisure_travel", "strong", 2),
    ("holidays", "airline_prices", "strong", 2),
    ("day_of_week", "tsa_volume", "strong", 0),
    ("gdp", "business_travel", "medium", 3),
    ("gdp", "leisure_travel", "medium", 3),
    ("employment", "business_travel", "strong", 2),
    ("consumer_confidence", "leisure_travel", "medium", 2),
    ("hotel_prices", "leisure_travel", "medium", 1),
    ("airline_prices", "leisure_travel", "strong", 1),
)
TARGET = "tsa_volume"
Z975 = 1.959963984540054


def nodes_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NODES), "node string, name string, type string")


def edges_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGES), "src string, dst string, strength string, lag int")


def simple_paths(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """K1: every simple directed path as ``(src, dst, path array)``; a path has at
    most ``max_len`` nodes, if given. A recursive query adds one edge per step; a
    path never comes back to a node, so cycles end. The session's limits on
    recursion (``spark.sql.cteRecursionLevelLimit``, ``...RowLimit``) raise an error
    where they are passed, never a shorter answer. Each step reads ``edges`` again, so
    an edge table that is costly to compute should be written first."""
    longest = f"AND size(p.path) < {int(max_len)}" if max_len else ""
    return edges.sparkSession.sql(f"""
      WITH RECURSIVE p(src, dst, path) AS (
        SELECT src, dst, array(src, dst) FROM {{e}} WHERE src <> dst
        UNION ALL
        SELECT p.src, e.dst, array_append(p.path, e.dst) FROM p JOIN {{e}} e ON p.dst = e.src
        WHERE NOT array_contains(p.path, e.dst) {longest})
      SELECT src, dst, path FROM p""", e=edges.select("src", "dst").distinct())


def reachable(edges: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` pairs of different nodes joined by a path. For graphs
    whose paths can be listed; :func:`closure` is for others."""
    return simple_paths(edges).select("src", "dst").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """The pairs of :func:`reachable` for large, dense or cyclic graphs: the reach
    doubles each round, rounds are written to the shared folder and end when
    nothing is added, so neither paths nor plans grow."""
    import uuid

    from paxcast.session import checkpoint_dir

    spark = edges.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/closure-{uuid.uuid4().hex}"
    reach, known, step = edges.select("src", "dst").distinct(), -1, 0
    while True:
        reach.write.parquet(f"{root}/{step}")
        reach = spark.read.schema(reach.schema).parquet(f"{root}/{step}")
        n = reach.count()
        if n == known:
            return reach.where("src <> dst")
        known, step = n, step + 1
        further = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src"))
        reach = reach.unionByName(further.select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))).distinct()


def descendants(edges: DataFrame) -> DataFrame:
    """K2: number of distinct descendants of every node with out-edges."""
    return reachable(edges).groupBy("src").agg(F.count("dst").alias("n_effects"))


def all_backdoor_paths(edges: DataFrame) -> DataFrame:
    """K3 for every pair: ``(cause, effect, path)``, the paths from a parent of the
    cause to the effect that avoid the cause. Avoiding it, they can't take the direct
    edge, so that needs no removal."""
    parents = edges.where("src <> dst").select(F.col("src").alias("_parent"), F.col("dst").alias("cause")).distinct()
    p = simple_paths(edges).join(parents, F.col("src") == F.col("_parent"))
    return p.where((F.col("dst") != F.col("cause")) & ~F.array_contains("path", F.col("cause"))).select(
        "cause", F.col("dst").alias("effect"), "path")


def adjustment_sets(edges: DataFrame) -> DataFrame:
    """K4 for every pair that a directed path joins: ``(cause, effect, controls)``, the
    nodes on its back-door paths without the two, sorted; empty if there are none."""
    pairs = reachable(edges).select(F.col("src").alias("cause"), F.col("dst").alias("effect"))
    nodes = all_backdoor_paths(edges).select("cause", "effect", F.explode("path").alias("_node")).where("_node <> effect")
    sets = nodes.groupBy("cause", "effect").agg(F.array_sort(F.collect_set("_node")).alias("controls"))
    return pairs.join(sets, ["cause", "effect"], "left").select(
        "cause", "effect", F.coalesce("controls", F.array().cast("array<string>")).alias("controls"))


def backdoor_paths(edges: DataFrame, cause: str, effect: str) -> DataFrame:
    """K3: the back-door paths of one pair as ``(src, dst, path)``."""
    p = all_backdoor_paths(edges).where((F.col("cause") == cause) & (F.col("effect") == effect))
    return p.select(F.col("path")[0].alias("src"), F.col("effect").alias("dst"), "path")


def adjustment_set(edges: DataFrame, cause: str, effect: str) -> DataFrame:
    """K4: every node on a back-door path of one pair, minus the cause and the effect."""
    n = backdoor_paths(edges, cause, effect).select(F.explode("path").alias("node")).distinct()
    return n.where(~F.col("node").isin(cause, effect))


def _t_pvalue(t: str, df: str) -> str:
    """Two-sided p-value of a t statistic (normal transform of the t
    distribution, accurate for large degrees of freedom)."""
    z = f"(abs({t}) * (1.0 - 1.0 / (4.0 * {df})) / sqrt(1.0 + {t} * {t} / (2.0 * {df})))"
    return f"(2.0 * (1.0 - {norm_cdf_sql(z)}))"


def _t_quantile(df: str) -> str:
    """97.5% t quantile by the Cornish-Fisher expansion around the normal one."""
    z = f"CAST({Z975!r} AS DOUBLE)"
    return (f"({z} + ({z}*{z}*{z} + {z}) / (4.0 * {df})"
            f" + (5.0*{z}*{z}*{z}*{z}*{z} + 16.0*{z}*{z}*{z} + 3.0*{z}) / (96.0 * {df} * {df}))")


def ols_effect(data: DataFrame, cause: str, effect: str, control: str | None = None) -> DataFrame:
    """K5: OLS of ``effect`` on a constant, ``cause`` and the levels of one
    categorical ``control`` (dummies): coefficient, std error, p-value, 95%
    interval, R^2 and n, as one row.

    By Frisch-Waugh-Lovell the cause's coefficient is the slope of the
    within-level deviations, so the fit needs only the sufficient statistics
    of each level (counts, means, second moments): one aggregation, no join.
    """
    d = data.select(F.col(cause).cast("double").alias("x"), F.col(effect).cast("double").alias("y"),
                    (F.col(control) if control else F.lit(0)).alias("g")).dropna()
    n = F.count(F.lit(1))
    levels = d.groupBy("g").agg(
        n.alias("n"), (F.covar_pop("x", "y") * n).alias("sxy"), (F.var_pop("x") * n).alias("sxx"),
        (F.var_pop("y") * n).alias("syy"), F.avg("y").alias("my"))
    total = F.sum("n")
    s = levels.agg(
        F.sum("sxy").alias("sxy"), F.sum("sxx").alias("sxx"), F.sum("syy").alias("syy"), total.alias("n"),
        F.count(F.lit(1)).alias("levels"),
        (F.sum(F.col("syy") + F.col("n") * F.col("my") * F.col("my"))
         - F.pow(F.sum(F.col("n") * F.col("my")), F.lit(2)) / total).alias("sst"),
    )
    s = s.withColumn("beta", F.col("sxy") / F.col("sxx"))
    s = s.withColumn("ssr", F.col("syy") - F.col("beta") * F.col("sxy"))
    s = s.withColumn("dof", (F.col("n") - 1 - F.col("levels")).cast("double"))
    s = s.withColumn("se", F.sqrt(F.col("ssr") / F.col("dof") / F.col("sxx")))
    s = s.withColumn("tstat", F.col("beta") / F.col("se"))
    s = s.withColumn("tq", F.expr(_t_quantile("dof")))
    return s.select(
        F.lit(cause).alias("cause"), F.lit(effect).alias("effect"),
        F.col("beta").alias("effect_estimate"), F.col("se").alias("std_err"),
        F.expr(_t_pvalue("tstat", "dof")).alias("p_value"),
        (F.col("beta") - F.col("tq") * F.col("se")).alias("conf_int_lower"),
        (F.col("beta") + F.col("tq") * F.col("se")).alias("conf_int_upper"),
        (1.0 - F.col("ssr") / F.col("sst")).alias("r_squared"),
        F.col("n").alias("n_obs"),
    )


def ols_effects(data: DataFrame, pairs: DataFrame, numeric: list[str], categorical: dict[str, list]) -> DataFrame:
    """K5 for a table of pairs (``cause``, ``effect``, ``controls`` array): OLS of the
    effect on a constant, the cause and its controls, one row per pair: coefficient,
    std error, p-value, 95% interval, R^2, n and the controls used.

    ``numeric``: measured columns, that may be cause, effect or control.
    ``categorical``: those that enter as dummies when they control, with their levels
    (the first is the base). Pairs with an unmeasured cause or effect give no row;
    unmeasured controls are left out. Rows with a null in any measured column are not
    used, so every pair is fitted on the same rows, by one aggregate."""
    measured = [*numeric, *(c for c in categorical if c not in numeric)]
    dummies = {c: [f"_{c}_{i}" for i in range(1, len(levels))] for c, levels in categorical.items()}
    x = data.select(*(F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in measured)).dropna()
    x = x.select(*numeric, *(F.when(F.col(c) == F.lit(levels[i]), 1.0).otherwise(0.0).alias(name)
                             for c, levels in categorical.items() for i, name in enumerate(dummies[c], 1)))
    columns = [*numeric, *(name for names in dummies.values() for name in names)]
    m = len(columns) + 1
    place = {c: i for i, c in enumerate(columns, 1)}
    one = regression.gram(x, [], columns).select(F.struct("rows", "g").alias("all")).scalar()

    def lookup(entries: dict) -> Column:
        return F.create_map(*(F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for kv in entries.items() for v in kv))

    own = lookup({c: [place[c]] for c in numeric})
    control = lookup({c: [place[d] for d in dummies[c]] if c in dummies else [place[c]] for c in measured})
    p = pairs.select("cause", "effect", F.filter("controls", lambda c: F.array_contains(F.lit(measured), c)).alias("controls"))
    p = p.where(F.col("cause").isin(numeric) & F.col("effect").isin(numeric))
    p = p.withColumn("_all", one).withColumn("_own", own).withColumn("_control", control)
    p = p.selectExpr(
        "cause", "effect", "controls", "_all.rows AS n", "_all.g AS g", "element_at(_own, cause)[0] AS c", "element_at(_own, effect)[0] AS e",
        "concat(array(0), element_at(_own, cause), flatten(transform(controls, k -> element_at(_control, k)))) AS _pivots")
    p = p.withColumn("s", regression.swept("g", "_pivots", m))
    p = p.selectExpr(
        "cause", "effect", "controls", "n", f"IF(s[c * {m} + c] < 0, s[c * {m} + e], NULL) AS beta", f"-s[c * {m} + c] AS factor", f"s[e * {m} + e] AS ssr",
        f"g[e * {m} + e] - try_divide(g[e] * g[e], n) AS sst", f"cast(nullif(greatest(n - size(filter(_pivots, k -> s[k * {m} + k] < 0)), 0), 0) AS double) AS dof")
    p = p.withColumn("se", F.expr("sqrt(greatest(ssr, 0D) / dof * factor)")).withColumn("tstat", F.expr("try_divide(beta, se)"))
    return _effect_rows(p.withColumn("tq", F.expr(_t_quantile("dof"))).withColumn("n_obs", F.col("n"))).withColumn("controls", F.array_join("controls", ","))


def ols_effect_ml(data: DataFrame, cause: str, effect: str, numeric=(), categorical=(), max_levels: int = 64) -> DataFrame:
    """K5 for one pair with numeric and categorical controls, whose levels are read
    from the data (an error beyond ``max_levels`` of one column)."""
    columns = list(dict.fromkeys([cause, effect, *numeric]))
    levels = {}
    for c in categorical:
        found = data.select(F.col(c)).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        levels[c] = [r[0] for r in found]
    pair = data.sparkSession.createDataFrame([(cause, effect, [*numeric, *categorical])], "cause string, effect string, controls array<string>")
    return ols_effects(data, pair, columns, levels)


def _effect_rows(s: DataFrame) -> DataFrame:
    return s.select(
        "cause", "effect", F.col("beta").alias("effect_estimate"), F.col("se").alias("std_err"),
        F.expr(_t_pvalue("tstat", "dof")).alias("p_value"), (F.col("beta") - F.col("tq") * F.col("se")).alias("conf_int_lower"),
        (F.col("beta") + F.col("tq") * F.col("se")).alias("conf_int_upper"), (1.0 - F.try_divide("ssr", "sst")).alias("r_squared"), "n_obs",
        *(["controls"] if "controls" in s.columns else []))


def correlated_edges(data: DataFrame, order: list[str], top: int) -> DataFrame:
    """An edge table learnt from data: of all pairs of columns, directed by their
    place in ``order``, the ``top`` with the largest absolute correlation. The table is
    computed here, once, and written to the shared folder: searches read it at every step."""
    x = data.select(*(F.col(c).cast("double").alias(c) for c in order)).dropna()
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1:]]
    found = x.agg(F.array(*(F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.abs(F.corr(a, b)).alias("weight")) for a, b in pairs)).alias("_e"))
    return materialise(found.select(F.inline("_e")).orderBy(F.col("weight").desc(), "src", "dst").limit(top).select("src", "dst"), "edges")


def trading_factors(edges: DataFrame, effects: DataFrame, target: str = TARGET) -> DataFrame:
    """K6: direct causes of the target with strength, lag and |effect| (0 if unknown)."""
    direct = edges.where(F.col("dst") == target)
    e = effects.where(F.col("effect") == target).select(F.col("cause").alias("src"), "effect_estimate")
    j = direct.join(e, "src", "left")
    return j.select(F.col("src").alias("factor"), "strength", "lag",
                    F.coalesce(F.abs("effect_estimate"), F.lit(0.0)).alias("effect_size"))


def risk_factors(nodes: DataFrame, edges: DataFrame, effects: DataFrame, target: str = TARGET) -> DataFrame:
    """K7: every non-target node with its number of descendants and
    |effect on the target| (0 if unknown), largest effect first."""
    n = nodes.where(F.col("type") != "target")
    d = descendants(edges).withColumnRenamed("src", "node")
    e = effects.where(F.col("effect") == target).select(F.col("cause").alias("node"), "effect_estimate")
    j = n.join(d, "node", "left").join(e, "node", "left")
    return j.select(F.col("node").alias("factor"), "type",
                    F.coalesce("n_effects", F.lit(0)).cast("bigint").alias("n_effects"),
                    F.coalesce(F.abs("effect_estimate"), F.lit(0.0)).alias("effect_size")) \
        .orderBy(F.col("effect_size").desc(), F.col("factor"))
