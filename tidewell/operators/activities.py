"""Activities: overlaps resolved, cut at shift and property changes, and their durations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.catalog import listed, operator
from tidewell.functions.scalars import micros
from tidewell.operators.joins import asof_join, merge_series


def resolve_overlaps(df: DataFrame, keys: list[str], start: str = "start_date", end: str = "end_date", activity: str = "activity", method: str = "PREFER_EARLIEST") -> DataFrame:
    """Activities of each group of ``keys`` without overlaps.

    PREFER_EARLIEST: in order (start, end descending, activity) a row that ends no
    later than all before it goes, and others start where those before end.
    PRESERVE_START: every start stays, or moves to a millisecond after the one
    before where it is not later; a row ends where the next starts.
    """
    order = Window.partitionBy(*keys).orderBy(start, F.col(end).desc(), activity)
    if method == "PREFER_EARLIEST":
        before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        kept = df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(end) > F.col("_before")))
        return kept.withColumn(start, F.greatest(F.col(start), F.col("_before"))).drop("_before")
    # the running maximum of (start - rank ms) moves equal or earlier starts on by a millisecond each
    rank = F.row_number().over(order)
    moved = df.withColumn("_r", rank).withColumn("_m", F.max(micros(F.col(start)) - F.col("_r") * 1000).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_r") * 1000)
    shifted = moved.withColumn(start, F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_m") / F.lit(1e6)))
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy("_r"))
    return shifted.withColumn(end, F.least(F.col(end), following)).drop("_r", "_m").where(F.col(end) > F.col(start))


def clip(df: DataFrame, first: datetime | None, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Activities from ``first`` on: those over by then go, others start no earlier."""
    if first is None:
        return df
    at = F.lit(first).cast("timestamp_ntz")
    return df.where(F.col(end) > at).withColumn(start, F.greatest(F.col(start), at))


def split_at(df: DataFrame, boundaries: DataFrame, entity: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Each activity cut at the entity's boundary times (column ``at``) inside it.

    A slice ends a millisecond before the next one starts.  An entity's boundaries
    are gathered once per activity that meets them by one aggregation.
    """
    times = boundaries.select(F.col(entity).alias("_e"), F.col("at").cast("timestamp_ntz").alias("_at")).distinct()
    keyed = df.withColumn("_id", F.xxhash64(*df.columns))
    inside = keyed.select(F.col(entity).alias("_e"), "_id", F.col(start).alias("_s"), F.col(end).alias("_x")).join(times, "_e").where("_s < _at and _at < _x")
    cuts = inside.groupBy("_id").agg(F.sort_array(F.collect_set("_at")).alias("_cuts"))
    joined = keyed.join(cuts, "_id", "left").withColumn("_starts", F.concat(F.array(F.col(start).cast("timestamp_ntz")), F.coalesce("_cuts", F.array().cast("array<timestamp_ntz>"))))
    part = joined.select("*", F.posexplode("_starts").alias("_i", "_from"))
    following = F.try_element_at("_starts", F.col("_i") + 2)
    out = part.withColumns({start: F.col("_from"), end: F.coalesce(following - F.expr("interval 1 millisecond"), F.col(end).cast("timestamp_ntz"))})
    return out.select(*df.columns)


def durations(df: DataFrame, name: str = "duration", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Minutes from start to end, to the second."""
    return df.withColumn(name, F.round((micros(F.col(end)) - micros(F.col(start))) / 1e6) / 60)


def activity_merge(df: DataFrame, ctx, tables: dict[str, list[str]], names: list[str], scope: str = "ACROSS_ALL", method: str = "PREFER_EARLIEST", boundaries: DataFrame | None = None, properties: dict[str, DataFrame] | None = None) -> DataFrame:
    """Durations of activities merged into the series at their starts.

    ``tables`` maps a table to the activity codes it is read for, ``names`` names the
    duration column of each table.  Overlaps are resolved within each activity or
    across all of a table; slices end at ``boundaries`` and changes of ``properties``.
    """
    spark, out = df.sparkSession, df
    for (table, codes), name in zip(tables.items(), names):
        rows = ctx.table(spark, table).select(ctx.entity, *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_date", "end_date")), "activity").where(F.col("activity").isin(*codes))
        rows = clip(rows, ctx.start)
        rows = resolve_overlaps(rows, [ctx.entity] + (["activity"] if scope == "WITHIN_SINGLE" else []), method=method)
        edges = boundaries
        for changes in (properties or {}).values():
            more = changes.select(ctx.entity, F.col("start_date").alias("at"))
            edges = more if edges is None else edges.unionByName(more)
        if edges is not None:
            rows = split_at(rows, edges, ctx.entity)
        rows = durations(rows, name).withColumn(ctx.timestamp, F.col("start_date"))
        for prop, changes in (properties or {}).items():
            right = changes.select(ctx.entity, F.col("start_date").alias("_at"), F.col(prop).alias(prop))
            rows = asof_join(rows, right, ctx.entity, ctx.timestamp, "_at", [prop])
        out = merge_series(out, rows, ctx, "outer")
    return out


@operator("ActivityDuration", outputs=("activity_duration",), kind="source")
def activity_duration(df, ctx, table_name, activity_codes, activity_duration="activity_duration", uniqueness_scope="ACROSS_ALL", method="PREFER_EARLIEST", additional_items=None, additional_output_names=None):
    return activity_merge(df, ctx, {table_name: listed(activity_codes)}, [activity_duration], uniqueness_scope, method)


@operator("SampleActivityDuration", outputs=("activity_duration",), kind="source")
def sample_activity_duration(df, ctx, input_activities, activity_duration=None, tables=None):
    """Several tables at once: ``tables`` maps each to its activity codes."""
    found = tables or {a: [a] for a in listed(input_activities)}
    return activity_merge(df, ctx, found, listed(activity_duration) or [f"{t}_duration" for t in found])
