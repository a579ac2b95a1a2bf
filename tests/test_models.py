"""Known answers for the models: recovered equations, honest bands, learnt weights."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from paxcast.operators import models, regression

START = dt.date(2023, 1, 1)
SCHEMA = "series string, date date, passengers double"


def frame(spark, series):
    return spark.createDataFrame([(k, START + dt.timedelta(days=i), float(v)) for k, vs in series.items() for i, v in enumerate(vs)], SCHEMA)


def ar_series(n, c, phi, noise, seed):
    rng = random.Random(seed)
    d, y = [0.0] * 9, [1000.0]
    for _ in range(n):
        d.append(c + phi[0] * d[-1] + phi[1] * d[-7] + phi[2] * d[-8] + rng.gauss(0, noise))
        y.append(y[-1] + d[-1])
    return y


def test_regression_matches_hand_solved_equations(spark):
    rows = [("a", float(i), float(i % 3), 2.0 + 3.0 * i - 4.0 * (i % 3)) for i in range(30)] + [("b", float(i), 2.0 * i, 1.0 - i) for i in range(30)]
    got = {r.k: r for r in regression.fit(spark.createDataFrame(rows, "k string, x double, z double, y double"), ["k"], ["x", "z"], "y").collect()}
    assert got["a"].beta == pytest.approx([2.0, 3.0, -4.0]) and got["a"].rank == 3 and got["a"].sse == pytest.approx(0, abs=1e-6)
    # z is twice x: it is left out, and the fit stays whole.
    assert got["b"].beta == pytest.approx([1.0, -1.0, 0.0]) and got["b"].rank == 2


def test_autoregression_recovers_each_series_own_equation(spark):
    truth = {"a": (0.5, (0.4, 0.3, -0.2)), "b": (-1.0, (-0.5, 0.2, 0.1))}
    daily = frame(spark, {k: ar_series(4000, c, phi, 1.0, i) for i, (k, (c, phi)) in enumerate(truth.items())})
    for r in models.seasonal_ar_fit(daily).collect():
        c, phi = truth[r.series]
        assert r.beta == pytest.approx([c, *phi], abs=0.06)
        assert r.sse / (r.rows - r.rank) == pytest.approx(1.0, abs=0.08)


def test_roll_out_and_its_variance(spark):
    phi = (0.4, 0.3, -0.2)
    y = ar_series(600, 0.2, phi, 1.0, 3)
    daily = frame(spark, {"a": y})
    fit = models.seasonal_ar_fit(daily).first()
    d = [b - a for a, b in zip(y, y[1:])]
    level, total, psi, want = y[-1], 0.0, [], []
    for _ in range(12):
        d.append(fit.beta[0] + fit.beta[1] * d[-1] + fit.beta[2] * d[-7] + fit.beta[3] * d[-8])
        level += d[-1]
        at = len(psi)
        psi.append(1.0 if not at else sum(b * psi[at - lag] for b, lag in zip(fit.beta[1:], (1, 7, 8)) if at >= lag))
        total += sum(psi) ** 2
        want.append((level, math.sqrt(fit.sse / (fit.rows - fit.rank) * total)))
    got = models.seasonal_ar_forecast(daily, horizon=12).orderBy("h").collect()
    assert [r.date for r in got] == [START + dt.timedelta(days=600 + h) for h in range(1, 13)]
    assert [r.prediction for r in got] == pytest.approx([w[0] for w in want])
    assert [r.uncertainty for r in got] == pytest.approx([w[1] for w in want])


def test_exogenous_days_ahead_enter_the_roll_out(spark):
    rng = random.Random(5)
    flags = [float(i % 5 == 0) for i in range(420)]
    y = [100.0]
    for i in range(1, 400):
        y.append(y[-1] + 10.0 * flags[i] - 2.0 + rng.gauss(0, 0.01))
    days = spark.createDataFrame([("a", START + dt.timedelta(days=i), flags[i], y[i] if i < 400 else None) for i in range(420)],
                                 "series string, date date, flag double, passengers double")
    known, future = days.where("passengers is not null"), days.where("passengers is null").select("series", "date", "flag")
    beta = models.seasonal_ar_fit(known, exog=["flag"]).first().beta
    assert beta[4] == pytest.approx(10.0, abs=0.2)
    got = models.seasonal_ar_forecast(known, exog=["flag"], future=future, horizon=10).orderBy("h").collect()
    steps = [b - a for a, b in zip([y[-1]] + [r.prediction for r in got], [r.prediction for r in got])]
    assert steps == pytest.approx([10.0 * flags[400 + h] - 2.0 for h in range(10)], abs=0.3)
    assert models.seasonal_ar_forecast(frame(spark, {"s": range(6)})).count() == 0


def test_conformal_bands_cover_untouched_rows(spark):
    rng = random.Random(9)
    draw = {"narrow": lambda: rng.gauss(3, 1), "skewed": lambda: rng.expovariate(0.1), "few": lambda: rng.gauss(0, 5)}
    held = [(k, f()) for k, f in draw.items() for _ in range(30 if k == "few" else 3000)]
    fresh = [(k, 100.0, 100.0 + f()) for k, f in draw.items() for _ in range(3000)]
    scored = spark.createDataFrame(fresh, "series string, prediction double, actual double")
    for level in (0.8, 0.95):
        out = models.conformal_bands(spark.createDataFrame(held, "series string, residual double"), scored, conf_level=level)
        cover = {r.series: r.c for r in out.groupBy("series").agg(F.avg(F.col("actual").between(F.col("lower_bound"), F.col("upper_bound")).cast("int")).alias("c")).collect()}
        assert cover["narrow"] == pytest.approx(level, abs=0.03) and cover["skewed"] == pytest.approx(level, abs=0.03)
        widths = {r.series: r.w for r in out.groupBy("series").agg(F.avg(F.col("upper_bound") - F.col("lower_bound")).alias("w")).collect()}
        assert widths["few"] != widths["narrow"] and widths["narrow"] < widths["skewed"]


@pytest.mark.parametrize("n", [40, 41, 99, 1000])
def test_band_ranks_are_exact(spark, n):
    values = random.Random(n).sample(range(10_000), n)
    held = spark.createDataFrame([("a", float(v)) for v in values], "series string, residual double")
    r = models.conformal_bands(held, spark.createDataFrame([("a", 0.0), ("new", 0.0)], "series string, prediction double")).collect()
    ordered = sorted(values)
    low, high = max(math.floor((n + 1) * 0.025 + 1e-9), 1), min(math.ceil((n + 1) * 0.975 - 1e-9), n)
    assert {(x.lower_bound, x.upper_bound) for x in r} == {(ordered[low - 1], ordered[high - 1])}


def test_huber_weights_find_the_mixture_and_shrug_off_outliers(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        a, b, c = (rng.uniform(50, 150) for _ in range(3))
        y = 0.7 * a + 0.3 * b + rng.gauss(0, 0.5) + (900 if i % 50 == 0 else 0)
        rows += [("s", i, m, p, y) for m, p in (("a", a), ("b", b), ("c", c))]
    w = {r.model: r.weight for r in models.huber_weights(spark.createDataFrame(rows, "series string, date int, model string, pred double, actual double")).collect()}
    assert w["a"] == pytest.approx(0.7, abs=0.02) and w["b"] == pytest.approx(0.3, abs=0.02) and w["c"] == pytest.approx(0, abs=0.02)
    assert sum(w.values()) == pytest.approx(1.0)


def test_out_of_fold_rows_never_see_their_model(spark):
    """Changing the days from a fold's start on changes no earlier prediction, and a
    fold's predictions are those of a fit on the rows before it."""
    rng = random.Random(4)
    y = [500 + 40 * math.sin(2 * math.pi * i / 7) + rng.gauss(0, 10) for i in range(300)]
    changed = y[:250] + [v + 10_000 for v in y[250:]]
    found = []
    for values in (y, changed):
        rows = models.out_of_fold_predictions(models.base_features(frame(spark, {"a": values}))).collect()
        found.append({(r.date, r.model): (r.fold, r.pred) for r in rows})
    cut = START + dt.timedelta(days=250)
    folds_before = {f for (d, _), (f, _) in found[0].items() if d < cut} - {f for (d, _), (f, _) in found[0].items() if d >= cut}
    assert len(folds_before) >= 3
    for (day, model), (fold, pred) in found[0].items():
        if day <= cut and fold in folds_before | {max(folds_before) + 1}:
            assert found[1][day, model][1] == pytest.approx(pred, rel=1e-9)
    last = max(f for f, _ in found[0].values())
    first_day = min(d for (d, _), (f, _) in found[0].items() if f == last)
    features = models.base_features(frame(spark, {"a": y}))
    names = models.BASE_MODELS["autoregressive"]
    beta = regression.fit(features.where(F.col("date") < F.lit(first_day)), ["series"], names, "actual").first().beta
    for r in features.where(F.col("date") >= F.lit(first_day)).collect():
        assert found[0][r.date, "autoregressive"][1] == pytest.approx(beta[0] + sum(b * r[c] for b, c in zip(beta[1:], names)))


def test_stack_learns_the_right_base_model(spark):
    """A pure weekly pattern: the calendar model is right, the others are not."""
    rng = random.Random(8)
    y = [500 + 100 * (i % 7) + 0.5 * i + rng.gauss(0, 30) for i in range(500)]
    daily = frame(spark, {"a": y})
    oof = models.out_of_fold_predictions(models.base_features(daily))
    w = {r.model: r.weight for r in models.huber_weights(oof).collect()}
    assert w["calendar"] > 0.8 and sum(w.values()) == pytest.approx(1.0) and min(w.values()) >= 0
    got = models.stacked_forecast(daily).collect()
    assert len(got) == 1 and got[0].date == START + dt.timedelta(days=500)
    assert got[0].prediction == pytest.approx(500 + 100 * (500 % 7) + 250, abs=40)


def test_smoothing_follows_a_damped_seasonal_series(spark):
    y = [200 + 10 * (i % 7) for i in range(140)]
    out = models.exp_smoothing_forecast(frame(spark, {"a": y, "short": range(14)}), horizon=10)
    got = out.where("series = 'a'").orderBy("h").collect()
    assert [r.forecast for r in got] == pytest.approx([200 + 10 * ((140 + h) % 7) for h in range(10)], abs=1e-6)
    assert [r.uncertainty for r in got] == pytest.approx([0.0] * 10, abs=1e-6)
    assert out.where("series = 'short'").first().error


def test_trees_learn_a_step_and_name_its_feature(spark):
    rng = random.Random(6)
    rows = [("a", START + dt.timedelta(days=i), (50.0 if (x := rng.random()) > 0.5 else 10.0) + rng.gauss(0, 1), x, rng.random()) for i in range(800)]
    data = models.holdout_split(spark.createDataFrame(rows, "series string, date date, target double, x double, noise double"), days=100)
    out, model = models.gbt_forecast(data.where("role = 'train'").drop("role"), data.where("role = 'validate'").drop("role"), ["x", "noise"], max_iter=10)
    r = out.agg(F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("mae"),
                F.avg(F.col("target").between(F.col("lower_bound"), F.col("upper_bound")).cast("int")).alias("cover"), F.count("*").alias("n")).first()
    assert r.n == 100 and r.mae < 2.5 and r.cover >= 0.85
    top = models.feature_importance(model, ["x", "noise"]).collect()
    assert top[0].feature == "x" and top[0].importance > 0.9 and sum(t.importance for t in top) == pytest.approx(1.0)
