"""Small models of one entity, served models, and helpers of models."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.catalog import Context, Step
from tidewell.operators import models as M

T0 = datetime(2024, 1, 1)
CTX = Context("e", "t")


def frame(spark, data):
    rows = [(e, T0 + timedelta(hours=i), float(a), float(b), None if y is None else float(y)) for e, part in data.items() for i, (a, b, y) in enumerate(part)]
    return spark.createDataFrame(rows, "e string, t timestamp_ntz, a double, b double, y double").repartition(3)


def cubic(seed, sign, n=150):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(-2, 2, n), rng.uniform(-2, 2, n)
    return list(zip(a, b, sign * (a**3 - a * b + 0.1 * rng.normal(size=n))))


def test_bayesian_ridge_with_powers(spark):
    data = {"up": cubic(1, 1), "down": cubic(2, -1), "few": [(1, 2, 3), (2, 3, 4)]}
    data["up"][7] = (1.0, 1.0, None)
    out = Step("BayesRidgeRegressorExt", features=["a", "b"], targets=["y"], predictions=["p"], deviations=["s"]).apply(frame(spark, data), CTX).toPandas()
    plain = Step("BayesRidgeRegressor", features=["a", "b"], targets=["y"], predictions=["p"], deviations=["s"]).apply(frame(spark, data), CTX).toPandas()
    for e in ("up", "down"):
        mine = out[(out["e"] == e) & out["y"].notna()]
        r2 = 1 - ((mine["y"] - mine["p"]) ** 2).sum() / ((mine["y"] - mine["y"].mean()) ** 2).sum()
        line = plain[(plain["e"] == e) & plain["y"].notna()]
        assert r2 > 0.95 and 1 - ((line["y"] - line["p"]) ** 2).sum() / ((line["y"] - line["y"].mean()) ** 2).sum() > 0.35
        assert mine["s"].between(0.05, 0.3).all()
    unknown = out[(out["e"] == "up") & out["y"].isna()]
    assert unknown["p"].iloc[0] == pytest.approx(0, abs=0.2)
    assert out[out["e"] == "few"]["p"].isna().all()


def test_ridge_by_evidence_agrees_with_its_equations():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.2 * rng.normal(size=80)
    model = M.BayesRidge.fit(x, y)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    alpha = 1 / model.noise
    gamma = (model.weights**2).sum()
    lam = np.linalg.inv(model.covariance)[0, 0] - alpha * (z.T @ z)[0, 0]
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + lam / alpha * np.eye(3), z.T @ (y - y.mean())), atol=1e-4)
    assert model.noise == pytest.approx(0.04, rel=0.4) and gamma > 4
    mean, spread = model.predict(x)
    assert np.corrcoef(mean, y)[0, 1] > 0.99 and (spread >= np.sqrt(model.noise)).all()


def test_density_of_several_items(spark):
    rng = np.random.default_rng(4)
    points = np.vstack((rng.normal(size=(120, 2)), [[8.0, 8.0]]))
    out = Step("KDEAnomalyScore", features=["a"], targets=["b"], predictions=["d"]).apply(frame(spark, {"one": [(a, b, 0) for a, b in points]}), CTX).orderBy("t").toPandas()
    cov = np.cov(points, rowvar=False) * len(points) ** (-2 / 6)
    off = points[:, None] - points
    exact = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", off, np.linalg.inv(cov), off)).sum(axis=1) / (len(points) * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
    assert np.allclose(out["d"], exact) and out["d"].idxmin() == 120


def test_served_models(spark):
    df = frame(spark, {"one": [(i, 2 * i, 0) for i in range(20)]})
    out = Step("InvokeServedModel", input_items=["a", "b"], output_items=["total"], call=lambda f: pd.DataFrame({"total": f["a"] + f["b"]})).apply(df, CTX)
    assert out.where("total = a + b").count() == 20 and out.columns == [*df.columns, "total"]
    told = Step("InvokeServedClassifier", input_items=["a"], output_items=["kind"], confidence="sure", call=lambda f: pd.DataFrame({"kind": np.where(f["a"] > 9, "big", "small"), "sure": 0.5})).apply(df, CTX)
    assert {(r["kind"], r["sure"]): r["count"] for r in told.groupBy("kind", "sure").count().collect()} == {("big", 0.5): 10, ("small", 0.5): 10}


def test_best_candidate_and_labels(spark):
    df = frame(spark, {"one": cubic(5, 1)})
    model = M.fit(df, ["a", "b"], "y", candidates=["gbt", "linear"], maxIter=10)
    assert model.name == "gbt" and model.score > 0.4 and not model.expired
    linear = M.fit(df.withColumn("y", 2 * F.col("a") + 1), ["a", "b"], "y", candidates=["gbt", "linear"], least_correlation=0.5, maxIter=3)
    assert linear.name == "linear" and linear.features == ["a"] and linear.score > 0.999
    predicted = linear.predict(df, "p").where(F.abs(F.col("p") - 2 * F.col("a") - 1) < 1e-3)
    assert predicted.count() == 150
    model.fitted, model.shelf_life_days = datetime(2020, 1, 1), 3
    assert model.expired
    named = M.index_labels(df.withColumn("k", F.when(F.col("a") > 1, "rare").otherwise("often")), "k", "n")
    assert {(r["k"], r["n"]) for r in named.select("k", "n").distinct().collect()} == {("often", 0.0), ("rare", 1.0)}
