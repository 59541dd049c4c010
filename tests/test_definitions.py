"""Losses, scores and lookups against their definitions, written out as loops."""

import math
from datetime import datetime

import numpy as np
import pytest

from tidewell.catalog import Context
from tidewell.functions import metrics
from tidewell.operators import anomaly, joins, shifts

SERIES = [
    (np.array([1.0, 2, 4, 3, 5, 4, 6, 8]), np.array([1.5, 2, 3, 3.5, 5, 5, 6, 7])),
    (np.sin(np.arange(40) / 3), np.sin(np.arange(40) / 3 + 0.4) * 1.3 + 0.1),
    (np.array([0.0, 1, 0, -1, 0]), np.array([2.0, 2, 2, 2, 2])),
]


def lagged(a, b, lag):
    return sum(a[t + lag] * b[t] for t in range(len(b)) if 0 <= t + lag < len(a))


@pytest.mark.parametrize("first, second", SERIES)
def test_losses(first, second):
    n = len(first)
    la, lb = math.sqrt(sum(first**2)), math.sqrt(sum(second**2))
    lags = range(-(n - 1), n)
    assert metrics.amplitude_loss(first, second) == pytest.approx(sum(abs(lagged(second, second, k) / lb**2 - lagged(second, first, k) / (la * lb)) for k in lags) / (2 * n - 1))
    e = [math.exp(d) for d in first - second]
    assert metrics.shift_loss(first, second) == pytest.approx(sum(abs(1 / n - x / sum(e)) for x in e))
    fa, fb = ([sum(x[t] * np.exp(-2j * math.pi * k * t / n) for t in range(n)) for k in range(n)] for x in (first, second))
    power = [abs(z) ** 2 for z in fb]
    top = sorted(range(n), key=lambda k: -round(power[k], 9))[: int(math.sqrt(n))]
    if len({round(p, 6) for p in power}) == n // 2 + 1:  # no ties but those of a real series' mirrored half
        strong = {k for k in range(n) if power[k] > n} | set(top) | {0}
        rest = [abs(fa[k]) for k in range(n) if k not in strong]
        expected = (sum(abs(fa[k] - fb[k]) for k in strong) / len(strong) + (sum(rest) / len(rest) if rest else 0)) / math.sqrt(n)
        assert metrics.phase_loss(first, second) == pytest.approx(expected, rel=0.05)
    steps = sum(abs(second[t] - first[t]) * (1 - math.tanh((first[t] - first[t - 1]) * (second[t] - second[t - 1]))) for t in range(1, n)) / (n - 1)
    a, b = ([x[t + 2] - x[t] for t in range(n - 2)] for x in (first, second))
    a, b = ([v - sum(x) / len(x) for v in x] for x in (a, b))
    scale = max(1e-8, math.sqrt(sum(v * v for v in a))) * max(1e-8, math.sqrt(sum(v * v for v in b)))
    along = sum(u * v for u, v in zip(a, b)) / scale
    assert metrics.trend(first, second) == pytest.approx(steps + 0.5 * (1 - along) * math.sqrt(sum((first - second) ** 2)))


def test_saliency_subtracts_a_trailing_mean():
    x = np.array([1.0, 3, 2, 5, 4, 7, 1, 2, 9, 4])
    f = np.fft.fft(x)
    log = [math.log(abs(z)) for z in f]
    local = [sum(log[max(0, i - 2) : i + 1]) / min(i + 1, 3) for i in range(len(x))]
    expected = np.abs(np.fft.ifft([z / abs(z) * math.exp(g - m) for z, g, m in zip(f, log, local)]))
    assert np.allclose(anomaly.saliency(x, 3), expected)


def test_scores_are_never_negative():
    assert anomaly.stretch(np.array([-2.0, 3.0]), 2).tolist() == [0.0, 3.0]


def test_robust_distance_marks_outliers():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x[:40] += 12
    d = anomaly.robust_distance(x)
    assert d[:40].min() > 5 * np.median(d[40:])


def test_company_and_calendar(spark):
    ctx = Context(entity="id", timestamp="ts")
    df = spark.createDataFrame([("d", datetime(2024, 1, d, h), c) for d, h, c in ((1, 3, "ABC"), (1, 6, "ACME"), (2, 23, "x"), (5, 1, None))], "id string, ts timestamp_ntz, company string")
    found = {r["ts"]: (r["currency_code"], r["employee_count"]) for r in joins.lookup_company(df, ctx).collect()}
    assert list(found.values()) == [("USD", 100), ("CAD", 120), (None, None), (None, None)]
    calendar = spark.createDataFrame(
        [(datetime(2024, 1, 1), "1", datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 14)), (datetime(2024, 1, 1), "2", datetime(2024, 1, 1, 14), datetime(2024, 1, 2, 5)), (datetime(2024, 1, 3), "1", datetime(2024, 1, 3, 5), datetime(2024, 1, 3, 14))],
        "shift_day timestamp_ntz, shift_id string, shift_start_date timestamp_ntz, shift_end_date timestamp_ntz",
    )
    tagged = {r["ts"]: r["shift_id"] for r in shifts.tag_by_calendar(df, ctx, calendar).collect()}
    assert tagged == {datetime(2024, 1, 1, 3): None, datetime(2024, 1, 1, 6): "1", datetime(2024, 1, 2, 23): "2", datetime(2024, 1, 5, 1): "1"}
