"""Alerts by counted occurrences, in blocks of an entity's time.

An alert clears the count, so what follows depends on the last alert alone.  Say that
occurrence i can fire if it and the k - 1 before it lie in one window: a condition on
its own past, found by a window function.  After an alert at j the next one is the
first that can fire from j + k on and after the quiet time of j, and the later j, the
later that is.  So a block of such occurrences is a step function from the last alert
before it to the last one in it.  Blocks report their steps in parallel, an entity's
steps are chained, and then all blocks fire in parallel from what they start with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import micros
from tidewell.operators.alerts import OccurrenceRule
from tidewell.sources.staging import staged

#: Occurrences that can fire, in one block.
BLOCK = 50_000
NEVER = -(1 << 62)


def able(rows: DataFrame, rule: OccurrenceRule) -> DataFrame:
    """Of ``rows`` (_e, _t, _on) the occurrences that can fire: _e, _t, their number _i, time _m in microseconds, and until when they quieten _q.

    Of rows with equal times those that are off come first.
    """
    order = Window.partitionBy("_e").orderBy("_t", "_on")
    before = F.coalesce(F.lag("_on").over(order), F.lit(False))
    happens = F.col("_on") & ~before if rule.rising else F.col("_on")
    found = rows.withColumn("_h", happens).where("_h").select("_e", "_t", micros(F.col("_t")).alias("_m"))
    window, quiet = round(rule.window * 1e6), round(rule.cooldown * 1e6)
    later = Window.partitionBy("_e").orderBy("_m")
    found = found.withColumns({"_i": F.row_number().over(later).cast("long"), "_k": F.lag("_m", rule.least - 1).over(later) if rule.least > 1 else F.col("_m")})
    start = F.col("_m") - window if rule.sliding else F.col("_m") - F.pmod(F.col("_m"), F.lit(window))
    within = F.col("_k") > start if rule.sliding else F.col("_k") >= start
    until = F.lit(NEVER) if not quiet else F.col("_m") + quiet if rule.sliding else start + window + quiet
    return found.where(within).select("_e", "_t", "_m", "_i", until.cast("long").alias("_q"))


def _next(pdf: pd.DataFrame, least: int) -> np.ndarray:
    """The place of the next alert after each place, were it one; the length where there is none."""
    i, m, q = (pdf[c].to_numpy(np.int64) for c in ("_i", "_m", "_q"))
    return np.maximum(np.searchsorted(i, i + least), np.searchsorted(m, q, side="right"))


def _steps(least: int):
    """A block to its steps: a first alert up to (_i, _m) leads to the last one at (_j, _q)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        following, last = _next(pdf, least), np.arange(len(pdf))
        for p in range(len(pdf) - 1, -1, -1):
            if following[p] < len(pdf):
                last[p] = last[following[p]]
        ends = np.append(last[1:] != last[:-1], True)
        out = pdf.loc[ends, ["_e", "_b", "_i", "_m"]].reset_index(drop=True)
        return out.assign(_j=pdf["_i"].to_numpy()[last[ends]], _q=pdf["_q"].to_numpy()[last[ends]])

    return run


def _chained(least: int):
    """An entity's steps to the last alert (_j, _q) before each of its blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, until, out = NEVER, NEVER, []
        for block, steps in pdf.groupby("_b", sort=True):
            out.append((pdf["_e"].iloc[0], block, at, until))
            steps = steps.sort_values("_i")
            open_ = (steps["_i"] >= at + least) & (steps["_m"] > until)
            if open_.any():
                at, until = (int(steps.loc[open_.idxmax(), c]) for c in ("_j", "_q"))
        return pd.DataFrame(out, columns=["_e", "_b", "_j", "_u"])

    return run


def _fired(least: int):
    """A block, with the last alert before it, to its alerts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        following = _next(pdf, least)
        p = int(max(np.searchsorted(pdf["_i"], pdf["_j"].iloc[0] + least), np.searchsorted(pdf["_m"], pdf["_u"].iloc[0], side="right")))
        hit = []
        while p < len(pdf):
            hit.append(p)
            p = int(following[p])
        return pdf.loc[hit, ["_e", "_t"]]

    return run


def occurrence_alerts(rows: DataFrame, rule: OccurrenceRule, block: int = BLOCK) -> DataFrame:
    """The entity _e and time _t of each alert over ``rows`` (_e, _t, _on); the same for any length of ``block``.

    Rows without an entity raise none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    key = f"_e {kinds['_e']}"
    number = F.row_number().over(Window.partitionBy("_e").orderBy("_i"))
    blocks = staged(able(rows.where("_e is not null"), rule).withColumn("_b", F.floor((number - 1) / block).cast("int")))
    steps = blocks.groupBy("_e", "_b").applyInPandas(_steps(rule.least), f"{key}, _b int, _i long, _m long, _j long, _q long")
    entered = steps.groupBy("_e").applyInPandas(_chained(rule.least), f"{key}, _b int, _j long, _u long")
    given = blocks.join(entered, ["_e", "_b"])
    return given.groupBy("_e", "_b").applyInPandas(_fired(rule.least), f"{key}, _t {kinds['_t']}").distinct()
