"""Boosted trees by entity against a plain version, stored models and their life cycle, and forecasts."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.catalog import Context, Step
from tidewell.operators import boosting as B
from tidewell.operators import models as M
from tidewell.operators.registry import LifeCycle, ModelRegistry, rank_correlation, to_learn

T0 = datetime(2024, 1, 1)
CTX = Context("e", "t", launch=datetime(2024, 6, 1))


def series(e, n, seed, kind="step"):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.integers(0, 9, n).astype(float)
    y = {"step": np.where(a > 0.3, 5.0, -1.0) + b, "line": 3 * a - b, "noise": rng.normal(size=n)}[kind] + 0.1 * rng.normal(size=n)
    return [(e, T0 + timedelta(hours=i), float(a[i]), float(b[i]), float(y[i])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "e string, t timestamp_ntz, a double, b double, y double").repartition(3)


def plain(x, y, edges, options):
    """The same trees for one entity, node by node."""
    base = y.mean()
    scale = max(y.max() - base, base - y.min()) or 1.0
    bins = np.array([[sum(c < v for c in edges[j]) for j, v in enumerate(row)] for row in x])
    f = np.full(len(y), base)
    for _ in range(options.trees):
        r = np.floor((y - f) / scale * B.UNIT + 0.5)
        nodes, leaves = [np.arange(len(y))], []
        for _ in range(options.depth):
            grown = []
            for rows in nodes:
                best = (1.0 + r[rows].sum() ** 2 / len(rows) * 1e-10, None)
                for j in range(x.shape[1]):
                    for b in range(len(edges[j])):
                        left = rows[bins[rows, j] <= b]
                        if min(len(left), len(rows) - len(left)) < options.least_rows:
                            continue
                        rest = r[rows].sum() - r[left].sum()
                        gain = r[left].sum() ** 2 / len(left) + rest**2 / (len(rows) - len(left)) - r[rows].sum() ** 2 / len(rows)
                        if gain > best[0]:
                            best = (gain, (j, b))
                if best[1] is None:
                    leaves.append(rows)
                else:
                    right = bins[rows, best[1][0]] > best[1][1]
                    grown += [rows[~right], rows[right]]
            nodes = grown
        for rows in leaves + nodes:
            f[rows] += r[rows].sum() / len(rows) / B.UNIT * scale * options.rate
    return f


def test_equals_a_plain_version(spark):
    data = {"one": series("one", 150, 1), "two": series("two", 90, 2, "line"), "few": series("few", 7, 3), "same": [("same", T0 + timedelta(hours=i), 1.0, 2.0, 4.0) for i in range(40)]}
    rows = frame(spark, [r for d in data.values() for r in d]).select(F.col("e").alias("_e"), F.array("a", "b").alias("_x"), F.col("y").alias("_y"))
    options = B.Boosting(trees=2, depth=2, rate=0.5, bins=16, least_rows=5)
    models = {r["_e"]: r["payload"] for r in B.fit_boosting(rows, options).collect()}
    assert set(models) == set(data)
    for e, d in data.items():
        x, y = np.array([r[2:4] for r in d]), np.array([r[4] for r in d])
        edges = json.loads(models[e])["edges"]
        assert all(set(c) <= set(x[:, j]) and len(c) <= 15 for j, c in enumerate(edges))
        assert np.allclose(B.evaluate(models[e], x), plain(x, y, edges, options), rtol=1e-7, atol=1e-7)
    assert np.allclose(B.evaluate(models["same"], np.zeros((2, 2))), 4.0)


def test_an_entity_of_many_rows_is_scored_in_parts(spark, monkeypatch):
    monkeypatch.setattr(B, "SCORED", 20)
    rows = frame(spark, series("one", 100, 1) + series("two", 5, 2)).select(F.col("e").alias("_e"), F.array("a", "b").alias("_x"), F.col("y").alias("_y"), F.col("t"))
    models = B.fit_boosting(rows.where("_e = 'one'"), B.Boosting(trees=1, depth=1))
    found = B.score_boosting(rows, models, "p").collect()
    payload = models.first()["payload"]
    want = {r["t"]: B.evaluate(payload, np.array([r["_x"]]))[0] for r in rows.where("_e = 'one'").collect()}
    assert len(found) == 105
    assert all(r["p"] == pytest.approx(want[r["t"]]) for r in found if r["_e"] == "one") and all(r["p"] is None for r in found if r["_e"] == "two")


def test_each_entity_has_its_own_model(spark):
    """Opposite relations in two entities: one model over both could learn neither."""
    up = [("up", T0 + timedelta(hours=i), float(i % 20), 0.0, float(i % 20)) for i in range(200)]
    down = [("down", t, a, b, -y) for _, t, a, b, y in up]
    odd = [("up", T0 - timedelta(hours=1), None, float("nan"), None), (None, T0, 1.0, 1.0, 1.0)]
    df = frame(spark, up + down + odd)
    out = Step("GBMRegressor", features=["a", "b"], targets=["y"], predictions=["p"], n_estimators=2, max_depth=2, learning_rate=0.9).apply(df, CTX)
    assert out.columns == ["e", "t", "a", "b", "y", "p"] and out.count() == 402
    rows = out.where("e is not null and y is not null").collect()
    off = np.mean([(r["p"] - r["y"]) ** 2 for r in rows])
    assert 1 - off / np.var([r["y"] for r in rows]) > 0.9
    assert out.where("e is null").first()["p"] is None and out.where("e = 'up' and y is null").first()["p"] is not None
    alarms = Step("SimpleAnomaly", features=["a"], targets=["y"], threshold=8, predictions=["p"], alerts=["hit"], n_estimators=2, max_depth=2, learning_rate=0.9).apply(df.withColumn("y", F.when(F.col("t") == F.lit(T0 + timedelta(hours=50)), 40.0).otherwise(F.col("y"))), CTX)
    assert {(r["e"], r["t"]) for r in alarms.where("hit").collect()} == {(e, T0 + timedelta(hours=50)) for e in ("up", "down")}


# stored models


def test_models_are_kept_and_learned_again(spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "models"), buckets=2)
    data = series("one", 200, 1) + series("two", 200, 2, "noise")

    def run(rows, at, life, e="one"):
        ctx = Context("e", "t", launch=at)
        out = Step("SimpleRegressor", features=["a", "b"], targets=["y"], predictions=["p"], n_estimators=2, max_depth=2, learning_rate=0.9, registry=registry, life=life).apply(frame(spark, rows), ctx)
        return {r["t"]: r["p"] for r in out.where(F.col("e") == e).collect()}

    def versions():
        return {(r["entity"], r["version"]): r for r in registry.versions("SimpleRegressor", "y").collect()}

    life = LifeCycle(shelf_life_days=10, stop_improving_at=0.4, least_correlation=0.0)
    first = run(data, T0, life)
    kept = versions()
    assert {k[0] for k in kept} == {"one", "two"} and kept["one", 1]["test_score"] > 0.4  # the bar of the first training
    assert kept["one", 1]["expires"] == T0 + timedelta(days=10) and kept["one", 1]["features"] == "a,b"
    # a second run on other data uses the stored model; the poor one is learned again and replaced only by a better one
    other = [(e, t, a, b, y + 100) for e, t, a, b, y in data]
    assert run(other, T0 + timedelta(days=1), life) == first
    assert ("one", 2) not in versions()
    # an expired one is learned again
    changed = run(other, T0 + timedelta(days=11), life)
    assert ("one", 2) in versions() and np.mean(list(changed.values())) > np.mean(list(first.values())) + 50
    # a bar above its score makes a model poor: only a better one comes in
    before = versions()["one", 2]["test_score"]
    run(other, T0 + timedelta(days=12), LifeCycle(stop_improving_at=before + 2, least_correlation=0.0))
    assert ("one", 3) not in versions()
    # a retired one gives null until there is another
    assert registry.retire("SimpleRegressor", "y", ["one"])
    off = LifeCycle(train=False, least_correlation=0.0)
    assert set(run(other, T0 + timedelta(days=13), off).values()) == {None}
    assert set(run(data, T0 + timedelta(days=13), LifeCycle(stop_improving_at=0.4, least_correlation=0.0)).values()) != {None}


def test_weak_correlation_bars_learning(spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "models"), buckets=2)
    data = [("line", t, a, b, a) for _, t, a, b, _ in series("line", 80, 1)] + series("noise", 80, 7, "noise")
    out = Step("GBMRegressor", features=["a", "b"], targets=["y"], predictions=["p"], n_estimators=1, max_depth=1, registry=registry, life=LifeCycle(least_correlation=0.5)).apply(frame(spark, data), CTX)
    given = {r["e"]: r["n"] for r in out.groupBy("e").agg(F.count("p").alias("n")).collect()}
    assert given == {"line": 80, "noise": 0}


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 5, 60).astype(float), rng.integers(0, 5, 60).astype(float) + np.arange(60) / 40
    rows = spark.createDataFrame([("a", [float(v), -float(v)], float(w)) for v, w in zip(x, y)], "_e string, _x array<double>, _y double")
    rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    want = abs(np.corrcoef(rank(x), rank(y))[0, 1])
    assert rank_correlation(rows).first()["_rho"] == pytest.approx(want)


def test_reasons_to_learn(spark):
    latest = spark.createDataFrame([("good", T0, None, 0.9), ("old", T0, T0, 0.9), ("poor", T0, None, 0.1), ("unscored", T0, None, None)], "entity string, fitted timestamp_ntz, expires timestamp_ntz, test_score double")
    names = spark.createDataFrame([(e,) for e in ("good", "old", "poor", "unscored", "new")], "entity string")
    found = {r["entity"]: r["why"] for r in to_learn(names, latest, LifeCycle(), T0 + timedelta(days=1)).collect()}
    assert found == {"old": "expired", "poor": "poor", "unscored": "poor", "new": "missing"}
    assert to_learn(names, latest, LifeCycle(train=False), T0).count() == 0


# forecasts


def test_forecasts_lie_after_the_data(spark):
    """The target follows a feature two rows before: the last rows of the result have no data and a right forecast."""
    rng = np.random.default_rng(6)
    rows = []
    for e in ("one", "two"):
        a = rng.integers(0, 4, 120).astype(float)
        rows += [(e, T0 + timedelta(hours=i), float(a[i]), 0.0, float(10 * a[i - 2]) if i > 1 else 0.0) for i in range(120)]
    df = frame(spark, rows + [("single", T0, 1.0, 0.0, 1.0)])
    out = Step("GBMForecaster", features=["a"], targets=["y"], predictions=["p"], lags=[2, 3], n_estimators=1, max_depth=2, learning_rate=1.0).apply(df, CTX)
    assert out.count() == 241 + 4
    for e in ("one", "two"):
        found = sorted((r["t"], r["y"], r["p"]) for r in out.where(F.col("e") == e).where(F.col("t") > F.lit(T0 + timedelta(hours=119))).select("t", F.coalesce("y", F.lit(-1.0)).alias("y"), "p").collect())
        a = [r[2] for r in rows if r[0] == e]
        assert [t for t, _, _ in found] == [T0 + timedelta(hours=120), T0 + timedelta(hours=121)] and all(y == -1 for _, y, _ in found)
        assert [p for _, _, p in found] == pytest.approx([10 * a[118], 10 * a[119]], abs=1.5)
    assert out.where("e = 'one' and p is null").count() == 3  # without all lags
    moved = Step("GBMRegressor", features=["a"], targets=["y"], predictions=["p"], lags=[2, 3], n_estimators=1, max_depth=2, learning_rate=1.0).apply(df, CTX)
    last = moved.where("e = 'one'").orderBy(F.desc("t")).first()
    assert moved.count() == 241 and last["p"] == pytest.approx(10 * last["a"], abs=1.5)
    with pytest.raises(ValueError):
        Step("GBMForecaster", features=["a"], targets=["y"], lags=[0]).apply(df, CTX)


def test_autoregressive_forecast(spark):
    wave = np.sin(np.arange(60) / 4)
    df = spark.createDataFrame([("a", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(wave)], "e string, t timestamp_ntz, v double")
    out = [r["f"] for r in Step("ARIMAForecaster", input_item="v", output_item="f", n_forecast=5).apply(df, CTX).orderBy("t").collect()]
    assert out[:55] == pytest.approx(wave[5:].tolist())
    assert out[55:] == pytest.approx(np.sin(np.arange(60, 65) / 4).tolist(), abs=1e-6)


# estimators over all entities


def test_classifiers(spark):
    rows = [(e, t, a, b, float(a > 0)) for e, t, a, b, _ in series("one", 200, 3)]
    df = frame(spark, rows)
    for name in ("BaseClassifier", "SimpleClassifier", "SimpleBinaryClassifier"):
        out = Step(name, features=["a", "b"], targets=["y"], predictions=["p"], n_estimators=5, max_depth=3).apply(df, CTX)
        assert out.where("p = y").count() > 180
    model = M.fit(df, ["a", "b"], "y", "classifier", ["perceptron"])
    assert model.name == "perceptron" and model.score > 0.9
    for name in ("BaseRegressor", "AutoRegScore"):
        out = Step(name, features=["a", "b"], targets=["y"], predictions=["p"], n_estimators=5).apply(df, CTX).where(F.abs(F.col("p") - F.col("y")) < 0.5)
        assert out.count() > 150
    with pytest.raises(TypeError):
        Step("BaseRegressor", features=["a"], targets=["y"], n_estimator=5).apply(df, CTX)
