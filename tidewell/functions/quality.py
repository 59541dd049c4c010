"""Data quality checks of a series per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.stationarity import SPAN, series_stationarity, series_white_noise, stationarity, white_noise
from tidewell.sources.staging import staged

#: Values of a series up to which the matches of its templates are looked up in a table of all pairs.
PAIRED = 512


def constant_value(c: Column) -> Column:
    return F.when(F.count(c) > 1, F.count_distinct(c) <= 1)


def stuck_at_zero(c: Column) -> Column:
    """Every value is 1e-7 or less, negative ones included."""
    return F.when(F.count(c) > 1, F.max(c) <= 1e-7)


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float | None:
    """-log of the share of template matches of length m that go on; null where undefined."""
    tolerance = r * x.std()
    if len(x) <= m + 1 or tolerance == 0:
        return None

    if len(x) <= PAIRED:
        high, low = np.maximum.outer(x, x), np.minimum.outer(x, x)
        near = high - low <= tolerance
        size = len(x) - m
        held = np.triu(near[:size, :size] & (high[:size, :size] <= low[:size, :size] + tolerance), 1)
        for k in range(1, m):
            held &= near[k : k + size, k : k + size]
        b, a = int(held.sum()), int((held & near[m : m + size, m : m + size]).sum())
        return -math.log(a / b) if a and b else None

    def matches(length: int) -> int:
        # a sorted first component leaves only near templates to compare
        t = np.lib.stride_tricks.sliding_window_view(x, length)[: len(x) - m]
        order = np.argsort(t[:, 0], kind="stable")
        t, found = t[order], 0
        ends = np.searchsorted(t[:, 0], t[:, 0] + tolerance, side="right")
        for i, end in enumerate(ends):
            if end > i + 1:
                found += int((np.abs(t[i + 1 : end] - t[i]).max(axis=1) <= tolerance).sum())
        return found

    a, b = matches(m + 1), matches(m)
    return -math.log(a / b) if a and b else None


_GROUPED = {"sample_entropy": (sample_entropy, "double")}
_BY_LAGS = {"stationarity": stationarity, "white_noise": white_noise}
_OF_SERIES = {"sample_entropy": (sample_entropy, pa.float64()), "stationarity": (series_stationarity, pa.string()), "white_noise": (series_white_noise, pa.bool_())}
_SIMPLE = {"constant_value": constant_value, "stuck_at_zero": stuck_at_zero}


def _checked(checks: list[str]):
    """Rows (_e, _o, _v) sorted by series to the checks of each."""
    from tidewell.operators.anomaly import whole_series

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_series(batches):
            values = table.column("_v").to_numpy()
            series = [values[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            found = [pa.array([_OF_SERIES[c][0](v) if len(v) > 1 else None for v in series], _OF_SERIES[c][1]) for c in checks]
            yield from pa.table([table.column("_e").take(pa.array(edges[:-1])), *found], ["_key", *checks]).to_batches()

    return run


def quality_checks(df: DataFrame, group: list[str], source: str, order: str, checks: list[str], span: int = SPAN) -> DataFrame:
    """The checks of each group's non-null values; groups of one value or none give null.

    The simple ones are one aggregation.  The others take series of up to ``span``
    values from sorted batches, many in one task; of longer series stationarity and
    white noise are sums over blocks, and sample entropy needs a series at once.
    """
    simple = [_SIMPLE[c](F.col(source)).alias(c) for c in checks if c in _SIMPLE]
    out = df.groupBy(*group).agg(*simple, F.count(source).alias("n_values"))
    others = [c for c in checks if c not in _SIMPLE]
    if not others:
        return out.select(*group, *checks, "n_values")
    key = F.to_json(F.struct(*group))
    short, long = df, None
    many = df.groupBy(key.alias("_key")).agg(F.count(source).alias("_n")).where(F.col("_n") > span).select("_key")
    if many.take(1):
        many = staged(many)
        long, short = (df.join(many, key == F.col("_key"), how) for how in ("left_semi", "left_anti"))
    value = F.nanvl(F.col(source).cast("double"), F.lit(None).cast("double"))
    rows = short.select(key.alias("_e"), F.col(order).alias("_o"), value.alias("_v")).where("_v is not null")
    # dealt by a fixed number: adaptive merging goes by bytes
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_e").sortWithinPartitions("_e", "_o", "_v")
    types = {c: str(_OF_SERIES[c][1]).replace("bool", "boolean") for c in others}
    found = dealt.mapInArrow(_checked(others), "_key string, " + ", ".join(f"{c} {t}" for c, t in types.items()))
    if long is not None:
        found = found.unionByName(_long_checks(long, group, source, order, others, span))
    out = out.join(found, key == F.col("_key"), "left").drop("_key")
    out = out.withColumns({c: F.when(F.col("n_values") > 1, F.col(c)) for c in others})
    return out.select(*group, *checks, "n_values")


def _long_checks(df: DataFrame, group: list[str], source: str, order: str, checks: list[str], span: int) -> DataFrame:
    """_key and the checks of groups with long series."""
    out = df.select(F.to_json(F.struct(*group)).alias("_key")).distinct()
    grouped = [c for c in checks if c in _GROUPED]
    if grouped:

        def run(pdf):
            import pandas as pd

            x = pdf.sort_values("_o")["_v"].dropna().to_numpy(float)
            return pd.DataFrame([{"_key": pdf["_key"].iloc[0], **{c: (_GROUPED[c][0](x) if len(x) > 1 else None) for c in grouped}}])

        rows = df.select(F.to_json(F.struct(*group)).alias("_key"), F.col(order).alias("_o"), F.col(source).cast("double").alias("_v"))
        more = rows.groupBy("_key").applyInPandas(run, "_key string, " + ", ".join(f"{c} {_GROUPED[c][1]}" for c in grouped))
        out = out.join(more, "_key", "left")
    for c in checks:
        if c in _BY_LAGS:
            out = out.join(_BY_LAGS[c](df, group, source, order, span).select(F.col("_e").alias("_key"), F.col(c)), "_key", "left")
    return out
