"""Checks of short series in one pass against those of long ones by blocks."""

from datetime import datetime, timedelta

import numpy as np

from tidewell.functions import quality


def test_short_and_long_series_get_the_same_checks(spark):
    rng = np.random.default_rng(3)
    data = {"noise": rng.normal(size=90), "walk": np.cumsum(rng.normal(size=90)), "wave": np.sin(np.arange(80) / 4), "flat": np.full(20, 0.1), "three": np.array([1.0, 2, 4]), "one": np.array([1.0]), "none": np.array([])}
    start = datetime(2024, 1, 1)
    rows = [(e, start + timedelta(minutes=i), float(v)) for e, x in data.items() for i, v in enumerate(x)]
    rows += [("none", start, None), ("walk", start - timedelta(days=1), None), ("noise", start - timedelta(days=2), float("nan"))]
    df = spark.createDataFrame(rows, "e string, t timestamp_ntz, v double")
    checks = ["sample_entropy", "stationarity", "white_noise"]
    short, long = ({r["e"]: r for r in quality.quality_checks(df, ["e"], "v", "t", checks, span=span).collect()} for span in (10_000, 15))
    assert short == long and set(short) == set(data)
    assert short["noise"]["white_noise"] and not short["walk"]["white_noise"]
    assert short["walk"]["sample_entropy"] == quality.sample_entropy(data["walk"])
    assert [short[e][c] for e in ("one", "none") for c in checks] == [None] * 6


def test_matches_in_a_table_are_those_of_sorted_templates(monkeypatch):
    rng = np.random.default_rng(4)
    series = [rng.exponential(5, n).round(1) for n in (4, 5, 30, 200, 512)] + [np.tile([1.0, 2, 1, 3], 20), np.zeros(9)]
    paired = [quality.sample_entropy(x) for x in series]
    monkeypatch.setattr(quality, "PAIRED", 0)
    assert paired == [quality.sample_entropy(x) for x in series]
