"""Overlap joins and the sweep over opens and closes, against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.catalog import Context, Step
from tidewell.operators import intervals as I

T0 = datetime(2024, 1, 1)
SPELL = "e string, s timestamp_ntz, x timestamp_ntz, p string"


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


@pytest.mark.parametrize("longest", [3, 500, 400_000])
def test_overlap_join_equals_all_pairs(spark, longest):
    rng = random.Random(longest)
    def spans(n, open_):
        out = []
        for i in range(n):
            a = rng.randrange(0, 100_000)
            b = a + rng.choice([0, 1, rng.randrange(longest), -1])
            out.append((rng.choice(["a", "a", "a", "b", None]), None if open_ and rng.random() < 0.1 else a, None if open_ and rng.random() < 0.1 else b, f"p{i}"))
        return out
    windows, spells = spans(150, True), spans(200, True)
    left = spark.createDataFrame([(e, at(a), at(b), p) for e, a, b, p in windows], "e string, f timestamp_ntz, t timestamp_ntz, w string")
    right = spark.createDataFrame([(e, at(a), at(b), p) for e, a, b, p in spells], SPELL)
    found = sorted((r["w"], r["p"]) for r in I.overlap_join(left, right, ["e"], ("f", "t"), ("s", "x")).collect())
    inf = float("inf")
    low, high = (lambda v: -inf if v is None else v), (lambda v: inf if v is None else v)
    want = sorted((w, p) for e, a, b, w in windows for k, s, x, p in spells if e is not None and e == k and high(x) >= low(a) and low(s) < high(b))
    assert found == want and len(want) > 50


def test_overlap_join_of_empty_sides_and_clashes(spark):
    left = spark.createDataFrame([("a", at(0), at(9), "w")], "e string, f timestamp_ntz, t timestamp_ntz, w string")
    right = spark.createDataFrame([("a", None, None, "p")], SPELL)
    assert [r["p"] for r in I.overlap_join(left, right, ["e"], ("f", "t"), ("s", "x")).collect()] == ["p"]
    assert I.overlap_join(left.limit(0), right, ["e"], ("f", "t"), ("s", "x")).count() == 0
    assert I.overlap_join(left, right.limit(0), ["e"], ("f", "t"), ("s", "x")).count() == 0
    with pytest.raises(ValueError):
        I.overlap_join(left, right.withColumnRenamed("p", "w"), ["e"], ("f", "t"), ("s", "x"))


def test_scd_data_and_the_step(spark):
    table = spark.createDataFrame([("a", at(0), at(10), "p"), ("a", at(10), None, "q"), ("b", None, at(5), "r"), ("b", at(50), at(60), "s")], SPELL)
    of = lambda *o, **k: sorted(r["p"] for r in I.scd_data(table, "e", *o, **k, start_name="s", end_name="x").collect())
    assert of() == ["p", "q", "r", "s"]
    assert of(at(5), at(10)) == ["p", "r"]
    assert of(at(6), None) == ["p", "q", "s"]
    assert of(None, at(50), ["b"]) == ["r"]
    df = spark.createDataFrame([("a", at(10)), ("b", at(55)), ("b", at(70)), ("c", at(1))], "e string, t timestamp_ntz")
    step = Step("SCDHistory", table_names={"p": "spells"}, start_name="s", end_name="x")
    found = step.apply(df, Context("e", "t", tables={"spells": table})).select("e", "value").collect()
    assert sorted(map(tuple, found)) == [("a", "p"), ("a", "q"), ("b", "s")]


def piecewise(spells, times):
    out = []
    for t in times:
        held = [(s, "" if p is None else p, p) for s, x, p in spells if s <= t < x]
        out.append(max(held, key=lambda h: h[:2])[2] if held else None)
    return out


@pytest.mark.parametrize("block, shape", [(50_000, "mixed"), (7, "mixed"), (1, "mixed"), (5, "nested"), (5, "chained")])
def test_default_lookup_equals_a_scan(spark, block, shape):
    rng = random.Random(block)
    spells = {"mixed": [(a, a + rng.choice([0, 1, 5, 40, 400, -3]), rng.choice(["p", "q", None]) and f"p{rng.randrange(9)}") for a in (rng.randrange(300) for _ in range(200))],
              "nested": [(i, 400 - i, f"p{i}") for i in range(150)], "chained": [(i, i + 30, f"p{i}") for i in range(0, 300, 2)]}[shape]
    times = list(range(-2, 420))
    left = spark.createDataFrame([(e, at(t)) for e in ("a", "none") for t in times], "e string, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(s), at(x), p) for s, x, p in spells] + [("b", at(0), at(9), "b"), ("a", None, at(3), "null"), (None, at(0), at(9), "null")], SPELL)
    found = {(r["e"], r["t"]): r["v"] for r in I.interval_default(left, right, "e", "t", "s", "x", "p", "v", "none", block).collect()}
    assert [found["a", at(t)] for t in times] == [v or "none" for v in piecewise(spells, times)]
    assert {found["none", at(t)] for t in times} == {"none"}


def test_a_heavy_entity_is_swept_in_blocks(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("a").alias("_e"), (F.col("id") * 10).alias("_s"), (F.lit(20 * n) - F.col("id") * 7).alias("_x"), F.col("id").cast("string").alias("_p"))
    found = {r["_c"]: r["_p"] for r in I.pieces(rows, block=5000).collect()}
    cuts, winner = I.last_opened(np.arange(n) * 10, 20 * n - np.arange(n) * 7, np.arange(n))
    times = sorted(found)
    values = dict(zip(cuts.tolist(), winner.tolist()))
    held, want = -1, {}
    for t in times:
        held = values.get(t, held)
        want[t] = str(held) if held >= 0 else None
    assert found == want and set(values) <= set(found)
    assert len(found) <= len(cuts) + 2 * 25  # a piece more where a block begins
