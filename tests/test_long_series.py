"""Scores of long series in blocks against those of a whole series at once."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.catalog import Context, Step
from tidewell.operators import anomaly, long_series

T0 = datetime(2024, 1, 1)
CTX = Context("e", "t")


def frame(spark, n=1500, odd=True):
    rng = np.random.default_rng(2)
    x = np.sin(np.arange(n) / 9) + rng.normal(size=n) / 5
    x[n // 2 : n // 2 + 15] += 4
    gaps = np.cumsum(rng.normal(60, 5, n) + 2000 * (np.arange(n) == n // 3))  # seconds: spread out, so that no half of the windows is degenerate
    rows = [("long", T0 + timedelta(seconds=float(gaps[i])), None if odd and i % 97 in (5, 6) or odd and i < 3 or odd and i > n - 3 else float(x[i])) for i in range(n)]
    rows += [("short", T0 + timedelta(minutes=i), float(x[i])) for i in range(60)] + [("tiny", T0, 1.0)]
    return spark.createDataFrame(rows, "e string, t timestamp_ntz, v double").repartition(4)


def scored(spark, name, whole, monkeypatch, block=200, **parameters):
    monkeypatch.setattr(long_series, "LONG", 10**9 if whole else 100)
    for f in ("robust_scores", "spectral_scores", "profile_scores", "robust_centres", "blocks", "cluster_scores", "change_scores"):
        fn = getattr(long_series, f)
        defaults = list(fn.__defaults__)
        defaults[-1] = block
        monkeypatch.setattr(fn, "__defaults__", tuple(defaults))
    outputs = parameters.pop("outputs", ["s"])
    out = Step(name, input_item="v", **parameters).apply(frame(spark), CTX).orderBy("e", "t").collect()
    return np.array([[np.nan if r[o] is None else r[o] for o in outputs] for r in out]), [r["e"] for r in out]


@pytest.mark.parametrize("name, parameters", [("MatrixProfileAnomalyScore", {}), ("SpectralAnomalyScore", {}), ("SpectralAnomalyScoreExt", {"inv_zscore": "i", "signal_energy": "w", "outputs": ["s", "i", "w"]})])
def test_scores_that_are_equal(spark, monkeypatch, name, parameters):
    whole, _ = scored(spark, name, True, monkeypatch, output_item="s", **dict(parameters))
    split, _ = scored(spark, name, False, monkeypatch, output_item="s", **dict(parameters))
    assert np.allclose(whole, split, rtol=1e-6, atol=1e-6, equal_nan=True)


@pytest.mark.parametrize("name", ["GeneralizedAnomalyScore", "GeneralizedAnomalyScoreV2", "FFTbasedGeneralizedAnomalyScore", "SaliencybasedGeneralizedAnomalyScore", "NoDataAnomalyScore"])
def test_robust_scores_agree(spark, monkeypatch, name):
    whole, entities = scored(spark, name, True, monkeypatch, output_item="s")
    split, _ = scored(spark, name, False, monkeypatch, output_item="s")
    long = np.array([e == "long" for e in entities])
    assert np.allclose(whole[~long], split[~long], equal_nan=True)
    a, b = whole[long, 0], split[long, 0]
    assert np.corrcoef(np.log1p(a), np.log1p(b))[0, 1] ** 2 > 0.9 and np.argmax(a) == pytest.approx(np.argmax(b), abs=15)


def test_clusters_and_change_points_agree(spark, monkeypatch):
    for name in ("KMeansAnomalyScore", "ChangePointDetector"):
        whole, entities = scored(spark, name, True, monkeypatch, output_item="s")
        split, _ = scored(spark, name, False, monkeypatch, output_item="s")
        long = np.array([e == "long" for e in entities])
        assert np.allclose(whole[~long], split[~long], equal_nan=True)
        a, b = whole[long, 0], split[long, 0]
        if name == "KMeansAnomalyScore":
            assert np.corrcoef(a, b)[0, 1] > 0.8 and abs(int(np.argmax(a)) - int(np.argmax(b))) <= 15
        else:
            assert np.abs(a - b).mean() < 0.05  # mostly the same points


def test_determinant_is_near_that_of_the_whole_series(spark):
    rng = np.random.default_rng(5)
    x = np.sin(np.arange(12_000) / 7) + rng.normal(size=12_000) / 3
    x[5000:5600] += 20
    rows = spark.createDataFrame([("a", i, 12_000, float(v)) for i, v in enumerate(x)], "_e string, _i long, _n long, _x double")
    dealt = long_series.blocks(rows, 8, block=1000)
    found = long_series.robust_centres(dealt, "plain", 8, 1000).first()
    cov = np.array(found["_c"]).reshape(8, 8)
    w = anomaly.windows_of(x, 8)
    ridge = long_series._ridge(w)
    best = min(long_series.concentrated(w, *long_series.centre_of(w[rng.choice(len(w), 9, replace=False)], ridge), ridge, 30)[0] for _ in range(40))
    assert np.exp(np.linalg.slogdet(cov)[1] - best) == pytest.approx(1, abs=0.05)
    assert np.abs(np.array(found["_m"])).max() < 1


def test_blocks_hold_each_window_once(spark):
    rows = spark.createDataFrame([("a", i, 50, float(i)) for i in range(50)], "_e string, _i long, _n long, _x double")
    for block in (7, 10, 50, 100):
        starts = [v for r in long_series.blocks(rows, 5, block=block).collect() for v in long_series._windows(r["_v"], 5)[:block][:, 0]]
        assert sorted(starts) == list(range(46))
