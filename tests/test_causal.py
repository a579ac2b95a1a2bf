"""Graph searches and effects against brute force and hand-made truths."""

import itertools
import random

import pytest

from paxcast.operators import causal


def graph(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def brute_paths(edges, src, dst):
    out, stack = [], [[src]]
    while stack:
        path = stack.pop()
        for a, b in sorted(set(edges)):
            if a == path[-1] and b not in path:
                (out if b == dst else stack).append([*path, b])
                if b == dst:
                    continue
    return out


def brute_sets(edges):
    nodes = sorted({n for e in edges for n in e})
    out = {}
    for cause, effect in itertools.permutations(nodes, 2):
        if brute_paths(edges, cause, effect):
            found = set()
            for parent in {a for a, b in edges if b == cause and a != cause} - {effect}:
                for path in brute_paths([e for e in edges if e != (cause, effect)], parent, effect):
                    if cause not in path:
                        found |= set(path)
            out[cause, effect] = sorted(found - {cause, effect})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sets_of_random_graphs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{a}", f"n{b}") for a, b in itertools.permutations(range(6), 2) if rng.random() < 0.35] + [("n0", "n0"), ("n1", "n2"), ("n1", "n2")]
    got = {(r.cause, r.effect): r.controls for r in causal.adjustment_sets(graph(spark, edges)).collect()}
    assert got == brute_sets(edges)
    paths = {(r.src, r.dst, tuple(r.path)) for r in causal.simple_paths(graph(spark, edges)).collect()}
    nodes = sorted({n for e in edges for n in e})
    assert paths == {(a, b, tuple(p)) for a, b in itertools.permutations(nodes, 2) for p in brute_paths(edges, a, b)}
    pairs = {(r.src, r.dst) for r in causal.closure(graph(spark, edges)).collect()}
    assert pairs == set(got) == {(r.src, r.dst) for r in causal.reachable(graph(spark, edges)).collect()}


def test_plan_does_not_grow_with_the_graph(spark):
    def size(n):
        plan = causal.simple_paths(graph(spark, [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n)]))
        return len(plan._jdf.queryExecution().analyzed().toString().splitlines())

    assert size(5) == size(60)


def test_closure_of_a_long_cycle(spark):
    n = 130  # beyond the recursion's limit on levels
    got = causal.closure(graph(spark, [(f"n{i}", f"n{(i + 1) % n}") for i in range(n)]))
    assert got.count() == n * (n - 1)


def test_effects_with_numeric_and_several_categorical_controls(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        season, day, gdp = rng.randint(1, 4), rng.randint(0, 6), rng.gauss(50, 5)
        price = 10 + 3 * season - day + 0.8 * gdp + rng.gauss(0, 1)
        rows.append((season, day, gdp, price, 5 * price - 20 * (season == 2) + 7 * (day == 6) + 2 * gdp + rng.gauss(0, 1)))
    data = spark.createDataFrame(rows, "season long, day long, gdp double, price double, volume double")
    pairs = spark.createDataFrame(
        [("price", "volume", ["season", "day", "gdp", "unmeasured"]), ("price", "volume2", []), ("gdp", "price", ["season", "day"]), ("price", "volume", [])],
        "cause string, effect string, controls array<string>")
    got = causal.ols_effects(data, pairs, ["gdp", "price", "volume"], {"season": [1, 2, 3, 4], "day": list(range(7))}).collect()
    found = {(r.cause, r.effect, r.controls): r for r in got}
    assert len(found) == len(got) == 3
    full = found["price", "volume", "season,day,gdp"]
    assert full.effect_estimate == pytest.approx(5.0, abs=0.06) and full.conf_int_lower < 5.0 < full.conf_int_upper and full.n_obs == 4000
    assert abs(found["price", "volume", ""].effect_estimate - 5.0) > 1.0  # confounded
    assert found["gdp", "price", "season,day"].effect_estimate == pytest.approx(0.8, abs=0.02)


def test_general_fit_agrees_with_the_ml_summary(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = random.Random(4)
    rows = [(x := rng.gauss(0, 1), z := x + rng.gauss(0, 1), 2 * x - z + rng.gauss(0, 2)) for _ in range(500)]
    data = spark.createDataFrame(rows, "x double, z double, y double")
    ours = causal.ols_effect_ml(data, "x", "y", numeric=["z"]).first()
    summary = LinearRegression(labelCol="y", solver="normal").fit(VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(data)).summary
    assert ours.std_err == pytest.approx(summary.coefficientStandardErrors[0], rel=1e-6)
    assert ours.r_squared == pytest.approx(summary.r2, rel=1e-6) and ours.p_value == pytest.approx(summary.pValues[0], abs=1e-4)


def test_dependent_controls_and_empty_tables(spark):
    data = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i + 1) for i in range(20)], "x double, z double, y double")
    r = causal.ols_effect_ml(data, "x", "y", numeric=["z"]).first()
    assert r.effect_estimate == pytest.approx(3.0)
    assert causal.ols_effect_ml(data.limit(0), "x", "y").count() <= 1
    assert causal.adjustment_sets(graph(spark, [("a", "b")]).limit(0)).count() == 0


def test_learnt_graph_reads_its_sample_once(spark, tmp_path, monkeypatch):
    from paxcast.plans import q_causal

    rng = random.Random(5)
    rows = []
    for i in range(400):
        season, day, gdp = 1 + i % 4, i % 7, rng.gauss(50, 5)
        price = 10 + 3 * season + 0.8 * gdp + rng.gauss(0, 1)
        rows.append((5 * price - 2 * day + rng.gauss(0, 1), price, rng.gauss(0, 1), season, gdp, day))
    rows.append((None, 1.0, 1.0, 1, 1.0, 0))
    data = spark.createDataFrame(rows, "tsa_volume double, airline_prices double, weather_severity double, season long, gdp double, day_of_week long")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    monkeypatch.setattr(q_causal, "_sample", lambda t: data.mapInPandas(counted, data.schema))
    got = q_causal.q_causal_learnt_graph(spark, str(tmp_path)).collect()
    assert read.value == len(rows)
    full = data.dropna().toPandas()
    pairs = list(itertools.combinations(q_causal.CAUSAL_ORDER, 2))
    top = sorted(pairs, key=lambda p: -abs(full[p[0]].corr(full[p[1]])))[:q_causal.LEARNT_EDGES]
    assert {(r.cause, r.effect): r.controls.split(",") if r.controls else [] for r in got} == brute_sets(top)
    assert {r.n_obs for r in got} == {400}
