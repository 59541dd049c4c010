"""Transforms over an entity's rows in time order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.catalog import listed, operator
from tidewell.functions.scalars import micros


def series(ctx):
    """An entity's rows in time order."""
    return Window.partitionBy(ctx.entity).orderBy(ctx.timestamp)


@operator("FillForwardByEntity", inputs=("input_item",), outputs=("output_item",))
def fill_forward(df, ctx, input_item, output_item="output_item"):
    so_far = series(ctx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(output_item, F.last(input_item, ignorenulls=True).over(so_far))


def interpolate(df: DataFrame, ctx, item: str, name: str, missing: float | None = None) -> DataFrame:
    """Nulls, and values equal to ``missing``, by a line in time between their neighbours.

    After the last value it is held; before the first there is none.
    """
    value = F.col(item).cast("double") if missing is None else F.when(F.col(item) != missing, F.col(item).cast("double"))
    point = F.when(value.isNotNull(), F.struct(value.alias("v"), micros(F.col(ctx.timestamp)).alias("t")))
    order = series(ctx)
    back = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(point, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumns({"_a": back, "_b": ahead})
    part = (micros(F.col(ctx.timestamp)) - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * part
    return out.withColumn(name, F.coalesce(line, F.col("_a.v"))).drop("_a", "_b")


@operator("Interpolator", inputs=("input_item",), outputs=("output_item",))
def interpolator(df, ctx, input_item, output_item, windowsize=None, missing=None):
    return interpolate(df, ctx, input_item, output_item, missing)


@operator("Derivative", inputs=("input_item",), outputs=("output_item",))
def derivative(df, ctx, input_item, output_item):
    """Differences of the interpolated series; the first is 0."""
    out = interpolate(df, ctx, input_item, "_x")
    return out.withColumn(output_item, F.coalesce(F.col("_x") - F.lag("_x").over(series(ctx)), F.lit(0.0))).drop("_x")


@operator("FeatureBuilder", inputs=("features",), outputs=("lagged_features",))
def feature_builder(df, ctx, features, lag, method, lagged_features):
    """Mean or standard deviation of the ``lag`` rows before, or with another method the row before."""
    before = series(ctx).rowsBetween(-lag, -1)
    run = {"mean": lambda c: F.avg(c).over(before), "std": lambda c: F.stddev_samp(c).over(before)}.get(method, lambda c: F.lag(c).over(series(ctx)))
    return df.withColumns({n: run(c) for c, n in zip(listed(features), listed(lagged_features))})


def _minutes(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / 6e7


@operator("TimeToFirstAndLastInDay", inputs=("input_item",), outputs=("time_to_first", "time_from_last"))
def time_to_first_and_last_in_day(df, ctx, input_item, time_to_first="time_to_first", time_from_last="time_from_last"):
    """Minutes from midnight to the day's first value and from its last to the next midnight."""
    day = F.date_trunc("day", F.col(ctx.timestamp)).cast("timestamp_ntz")
    group = Window.partitionBy(ctx.entity, day)
    at = F.when(F.col(input_item).isNotNull(), F.col(ctx.timestamp))
    return df.withColumns({time_to_first: _minutes(day, F.min(at).over(group)), time_from_last: 1440.0 - _minutes(day, F.max(at).over(group))})


@operator("TimeToFirstAndLastInShift", inputs=("input_item",), outputs=("time_to_first", "time_from_last"))
def time_to_first_and_last_in_shift(df, ctx, input_item, time_to_first="time_to_first", time_from_last="time_from_last", keys=("shift_day", "shift_id"), bounds=("shift_start_date", "shift_end_date")):
    group = Window.partitionBy(ctx.entity, *keys)
    at = F.when(F.col(input_item).isNotNull(), F.col(ctx.timestamp))
    return df.withColumns({time_to_first: _minutes(F.col(bounds[0]), F.min(at).over(group)), time_from_last: _minutes(F.max(at).over(group), F.col(bounds[1]))})


def state_change(df: DataFrame, ctx, source: str, condition: str, value) -> DataFrame:
    """``_state`` (0/1) and ``_change`` from the row before; an entity's first change is 2."""
    c, v = F.col(source), F.lit(value)
    test = {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "==": c == v, "!=": c != v, "=": c == v}[condition]
    out = df.withColumn("_state", F.coalesce(test, F.lit(False)).cast("int"))
    return out.withColumn("_change", F.coalesce(F.col("_state") - F.lag("_state").over(series(ctx)), F.lit(2)))


@operator("StateTimePreparation", inputs=("source",), outputs=("name",))
def state_time_preparation(df, ctx, source, state_name, name, condition="=="):
    """Texts "change,state,seconds since 1970,entity" for a sum of time in a state."""
    out = state_change(df, ctx, source, condition, state_name)
    seconds = F.floor(micros(F.col(ctx.timestamp)) / 1e6).cast("long")
    return out.withColumn(name, F.concat_ws(",", F.col("_change"), F.col("_state"), seconds, F.col(ctx.entity).cast("string"))).drop("_change", "_state")


def decoded_time_in_state(df: DataFrame, ctx, source: str, name: str, keys: list[str]) -> DataFrame:
    """Seconds in the state per group from texts that ``StateTimePreparation`` made.

    Rows of one second follow by their full times, so the last state of it lasts on.
    """
    part = F.split(F.col(source), ",")
    within = F.col(ctx.timestamp) if ctx.timestamp in df.columns else F.lit(None)
    rows = df.select(*keys, part.getItem(1).cast("int").alias("_on"), part.getItem(2).cast("double").alias("_s"), within.alias("_t"))
    order = Window.partitionBy(*keys).orderBy("_s", "_t", "_on")
    lasts = F.coalesce(F.lead("_s").over(order) - F.col("_s"), F.col("_s") - F.lag("_s").over(order), F.lit(0.0))
    return rows.withColumn("_d", lasts).groupBy(*keys).agg(F.sum(F.when(F.col("_on") == 1, F.col("_d")).otherwise(0.0)).alias(name))


def with_end_dates(df: DataFrame, entity: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """End of each change: one microsecond before the next, and far ahead for the last."""
    following = F.lead(start).over(Window.partitionBy(entity).orderBy(start))
    return df.withColumn(end, F.coalesce(following.cast("timestamp_ntz") - F.expr("interval 1 microsecond"), F.lit(datetime(2262, 4, 11)).cast("timestamp_ntz")))


def moving_average(df: DataFrame, ctx, item: str, name: str, size: int = 3) -> DataFrame:
    return df.withColumn(name, F.avg(item).over(series(ctx).rowsBetween(-(size - 1), 0)))


def least_gap(df: DataFrame, ctx, floor_seconds: float = 5.0) -> DataFrame:
    """The least seconds between an entity's rows, ``floor_seconds`` at least."""
    gap = (micros(F.col(ctx.timestamp)) - micros(F.lag(ctx.timestamp).over(series(ctx)))) / 1e6
    return df.withColumn("_gap", gap).groupBy(ctx.entity).agg(F.greatest(F.min("_gap"), F.lit(floor_seconds)).alias("min_gap_s"))


def latest_rows(df: DataFrame, history: DataFrame, ctx, limit: int) -> DataFrame:
    """The frame with up to ``limit`` of each entity's latest earlier rows of ``history``."""
    first = df.groupBy(ctx.entity).agg(F.min(ctx.timestamp).alias("_first"))
    older = history.join(first, ctx.entity).where(F.col(ctx.timestamp) < F.col("_first")).drop("_first")
    ranked = older.withColumn("_n", F.row_number().over(Window.partitionBy(ctx.entity).orderBy(F.col(ctx.timestamp).desc())))
    return df.unionByName(ranked.where(F.col("_n") <= limit).drop("_n"), allowMissingColumns=True)


operator("DataExpanderTransformer", inputs=("input_items",), kind="source")(lambda df, ctx, input_items, history_table, limit=10_000: latest_rows(df, ctx.table(df.sparkSession, history_table), ctx, limit))
