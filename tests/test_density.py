"""Binned kernel densities against exact sums."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.catalog import Context, Step
from tidewell.operators import density as D

T0 = datetime(2024, 1, 1)
CTX = Context("e", "t")
RNG = np.random.default_rng(8)
DATA = {
    "normal": RNG.normal(5, 2, 400), "two": np.concatenate((RNG.normal(0, 0.3, 200), RNG.normal(40, 0.3, 150))), "far": np.append(RNG.normal(size=200), 1e6),
    "few": np.array([1.0, 2.0, 4.0]), "same": np.full(9, 3.5), "one": np.array([7.0]), "ties": RNG.integers(0, 4, 300).astype(float),
}


def exact(x, at):
    h = x.std(ddof=1) * len(x) ** -0.2
    return np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi)), h


def frame(spark):
    rows = [(e, T0 + timedelta(minutes=i), float(v)) for e, x in DATA.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows + [("normal", T0, None), ("normal", T0, float("nan")), (None, T0, 1.0)], "e string, t timestamp, v double").repartition(3)


def test_densities_are_exact_within_the_stated_error(spark):
    rows = frame(spark).select(F.col("e").alias("_e"), F.nanvl("v", F.lit(None).cast("double")).alias("_x"))
    known = rows.where("_x is not null and _e is not null")
    widths = {r["_e"]: r for r in D.bandwidths(known).collect()}
    cells = D.density_cells(known, D.bandwidths(known)).collect()
    for e in ("normal", "two", "far", "few", "ties"):
        w = widths[e]
        mine = [(w["_low"] + r["_c"] * w["_h"] / D.PER, r["_d"]) for r in cells if r["_e"] == e]
        want, h = exact(DATA[e], np.array([m[0] for m in mine]))
        assert w["_h"] == pytest.approx(h) and np.abs(want - [m[1] for m in mine]).max() <= D.ERROR / (h * math.sqrt(2 * math.pi))
    found = D.density_at(rows).collect()
    assert len(found) == rows.count()
    for e in ("normal", "two", "ties"):
        mine = sorted((r["_x"], r["_p"]) for r in found if r["_e"] == e and r["_x"] is not None)
        want, h = exact(DATA[e], np.array([m[0] for m in mine]))
        assert np.abs(want - [m[1] for m in mine]).max() <= 2 * D.ERROR / (h * math.sqrt(2 * math.pi))
    assert {r["_p"] for r in found if r["_e"] in ("same", "one")} == {0.0} and all(r["_p"] is None for r in found if r["_e"] is None or r["_x"] is None)


def test_range_of_dense_values(spark):
    out = Step("RobustThresholdKDE", input_item="v", threshold=0.2, output_item="inside").apply(frame(spark), CTX).collect()
    for e in ("normal", "two", "ties", "few"):
        x = DATA[e]
        grid = np.linspace(x.min() - 1, x.max() + 1, 20_001)
        d, h = exact(x, grid)
        low, high = grid[d >= 0.2 * d.max()][[0, -1]]
        for r in out:
            if r["e"] == e and r["v"] is not None and r["v"] == r["v"] and min(abs(r["v"] - low), abs(r["v"] - high)) > h / 4:
                assert r["inside"] == (low <= r["v"] <= high)
    assert all(r["inside"] for r in out if r["e"] in ("same", "one"))
    assert [r["inside"] for r in out if r["e"] == "far" and r["v"] > 1e5] == [False]
    assert [r["inside"] for r in out if r["e"] is None or r["v"] is None] == [None, None]
    spread = {r["e"]: r["range"] for r in Step("KDEMaxMin", input_item="v", output_item="range").apply(frame(spark), CTX).collect()}
    assert spread["same"]["least"] == spread["same"]["most"] == 3.5 and spread["normal"]["least"] < 1 and spread["normal"]["most"] > 9
