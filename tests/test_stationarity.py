"""Unit-root, level and noise tests from sums over blocks against their definitions on whole series."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import stationarity as S
from tidewell.functions.quality import quality_checks

T0 = datetime(2024, 1, 1)


def made():
    rng = np.random.default_rng(12)
    e = rng.normal(size=400)
    ar = np.zeros(400)
    for i in range(1, 400):
        ar[i] = 0.6 * ar[i - 1] + e[i]
    return {
        "noise": e, "walk": np.cumsum(e), "ar": ar + 100, "trend": np.arange(300) / 10 + rng.normal(size=300), "waves": np.sin(np.arange(250) / 5) + rng.normal(size=250) / 9,
        "flips": np.where(np.arange(120) % 2, 1.0, -1.0) + rng.normal(size=120) / 9, "short": rng.normal(size=9), "four": np.array([1.0, 3.0, 2.0, 5.0]),
        "two": np.array([1.0, 2.0]), "same": np.full(30, 4.0), "one": np.array([1.0]),
    }


def frame(spark, data):
    rows = [(e, T0 + timedelta(minutes=i), float(v)) for e, x in data.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows + [("noise", T0 - timedelta(hours=1), None), ("ar", T0 - timedelta(hours=1), float("nan"))], "e string, t timestamp_ntz, v double").repartition(5)


def least_squares(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    return rest @ rest, beta[1] / math.sqrt(rest @ rest / max(1, len(y) - x.shape[1]) * np.linalg.pinv(x.T @ x)[1, 1])


def adf(x):
    most, d = S.most_lags(len(x)), np.diff(x)
    design = lambda lags, first: np.column_stack([np.ones(len(d) - first), x[first:-1], *(d[first - k : len(d) - k] for k in range(1, lags + 1))])
    rows = len(d) - most
    lags = min((rows * math.log(least_squares(design(k, most), d[most:])[0] / rows) + 2 * (k + 2), k) for k in range(most + 1))[1]
    return least_squares(design(lags, lags), d[lags:])[1]


def kpss(x):
    n, e = len(x), x - x.mean()
    first = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, first + 1):
        product = e[i:] @ e[:-i] / (n / 2)
        s0, s1 = s0 + product, s1 + i * product
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))
    long_run = (e @ e + 2 * sum((e[k:] @ e[:-k]) * (1 - k / (lags + 1)) for k in range(1, lags + 1))) / n
    return (np.cumsum(e) ** 2).sum() / n**2 / long_run


@pytest.mark.parametrize("span", [10_000, 40])
def test_statistics_equal_their_definitions(spark, span):
    data = made()
    found = {eval(r["_e"])["e"]: r for r in S.stationarity(frame(spark, data), ["e"], "v", "t", span).collect()}
    assert set(found) == set(data)
    for e in ("noise", "walk", "ar", "trend", "waves", "flips", "short"):
        assert found[e]["adf"] == pytest.approx(adf(data[e]), rel=1e-6), e
        assert found[e]["kpss"] == pytest.approx(kpss(data[e]), rel=1e-6), e
    verdicts = {e: r["stationarity"] for e, r in found.items()}
    assert (verdicts["noise"], verdicts["ar"], verdicts["walk"], verdicts["same"], verdicts["two"], verdicts["one"]) == ("Stationary", "Stationary", "Not Stationary", "Constant Data", S.TOO_SHORT, S.TOO_SHORT)
    assert verdicts["trend"] in ("Difference Stationary", "Not Stationary") and verdicts["four"] in S.VERDICTS.values()


def test_p_values_agree_with_tables():
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert S.dickey_fuller_p(t) == pytest.approx(p, rel=0.05)
    assert S.dickey_fuller_p(3) == 1 and S.dickey_fuller_p(-30) == 0
    assert (S.kpss_p(0.1), S.kpss_p(0.463), S.kpss_p(5)) == (0.10, 0.05, 0.01)
    for x, k in ((3.841, 1), (18.307, 10), (124.342, 100), (1074.679, 1000)):  # the chi-squared table at 5 per cent
        assert S.upper_gamma(k / 2, x / 2) == pytest.approx(0.05, abs=2e-5)
    assert S.upper_gamma(2.5, 0) == 1


@pytest.mark.parametrize("span, lags", [(10_000, 64), (30, 3)])
def test_white_noise_equals_a_test_at_all_lags(spark, monkeypatch, span, lags):
    monkeypatch.setattr(S, "MORE_LAGS", 3)
    data = {e: x for e, x in made().items() if len(x) > 1}
    want = {}
    for e, x in data.items():
        n, c = len(x), x - x.mean()
        if not c.any():
            want[e] = True
            continue
        q, small = 0.0, 0
        for k in range(1, n):
            q += n * (n + 2) * ((c[k:] @ c[:-k]) / (c @ c)) ** 2 / (n - k)
            small += S.upper_gamma(k / 2, q / 2) < 0.05
        want[e] = small < n - 1
    found = {eval(r["_e"])["e"]: r["white_noise"] for r in S.white_noise(frame(spark, data), ["e"], "v", "t", span, lags).collect()}
    assert found == want and {found["walk"], found["ar"], found["noise"]} == {False, True}


def test_lagged_sums(spark):
    x = np.random.default_rng(3).normal(size=100)
    rows = spark.createDataFrame([("a", i, float(v), 30) for i, v in enumerate(x)], "_e string, _i long, _x double, _l int").repartition(3)
    for span in (10_000, 31, 1):
        found = {r["_k"]: r["_s"] for r in S.lagged_sums(rows, "_l", span).collect()}
        assert found == pytest.approx({k: float(x[k:] @ x[: len(x) - k]) for k in range(31)})


def test_quality_checks_have_a_row_for_each_group(spark):
    data = made()
    out = quality_checks(frame(spark, data), ["e"], "v", "t", ["constant_value", "stationarity", "white_noise"]).collect()
    assert {r["e"]: r["n_values"] for r in out} == {e: len(x) + (e == "ar") for e, x in data.items()}
    found = {r["e"]: (r["constant_value"], r["stationarity"], r["white_noise"]) for r in out}
    assert found["one"] == (None, None, None) and found["same"] == (True, "Constant Data", True) and found["walk"] == (False, "Not Stationary", False)
