"""Generated series, dimensions, activities and changes, and injected anomalies."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.catalog import listed, operator
from tidewell.functions.random_values import choice
from tidewell.functions.scalars import micros
from tidewell.operators.windows import series, with_end_dates


def time_grid(spark: SparkSession, entities: list[str], start: datetime, end: datetime, freq: str = "1 minute", entity: str = "entity_id", ts: str = "ts") -> DataFrame:
    names = spark.createDataFrame([(e,) for e in entities], f"`{entity}` string")
    every = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"interval {freq}"))
    return names.withColumn(ts, F.explode(every))


def metric(ts: Column, mean: float, sd: float, seed: int, increase_per_day: float = 0.0001, noise: float = 0.1, day_harmonic: float = 0.2, day_of_week_harmonic: float = 0.2, origin: datetime = datetime(2024, 1, 1)) -> Column:
    """Noise, a trend and harmonics of the day and the week around a mean."""
    days = (micros(ts) - micros(F.lit(origin).cast("timestamp_ntz"))) / 8.64e10
    day, week = F.sin(2 * 3.141592653589793 * F.hour(ts) / 24), F.sin(2 * 3.141592653589793 * F.weekday(ts) / 7)
    return mean + sd * (F.randn(seed) * noise + days * increase_per_day + day * day_harmonic + week * day_of_week_harmonic)


def time_series(spark: SparkSession, entities: list[str], start: datetime, end: datetime, metrics: dict[str, tuple[float, float]], categoricals: dict[str, list[str]] | None = None, dates: list[str] | None = None, freq: str = "1 minute", seed: int = 1, **options) -> DataFrame:
    """A generated series: metrics by (mean, sd), categories, and dates in the 30 days before."""
    grid = time_grid(spark, entities, start, end, freq)
    columns = {n: metric(F.col("ts"), m, s, seed + i, **options) for i, (n, (m, s)) in enumerate(metrics.items())}
    columns |= {n: choice(values, None, seed + 100 + i) for i, (n, values) in enumerate((categoricals or {}).items())}
    columns |= {n: F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.rand(seed + 200 + i) * 2_592_000) for i, n in enumerate(dates or [])}
    return grid.withColumns(columns)


def activities(spark: SparkSession, entities: list[str], codes: list[str], start: datetime, end: datetime, seed: int = 1, keep: float = 0.3) -> DataFrame:
    """About ``keep`` of the hours start an activity of some hours."""
    grid = time_grid(spark, entities, start, end, "1 hour", ts="start_date").where(F.rand(seed) < keep)
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.abs(F.randn(seed + 1)) * 3600)
    return grid.withColumns({"end_date": F.col("start_date") + length, "activity": choice(codes, None, seed + 2)})


def dimension(spark: SparkSession, entities: list[str], numbers: dict[str, tuple[float, float]] | None = None, domains: dict[str, list[str]] | None = None, seed: int = 1) -> DataFrame:
    rows = spark.createDataFrame([(e,) for e in entities], "entity_id string")
    columns = {n: F.randn(seed + i) * s + m for i, (n, (m, s)) in enumerate((numbers or {}).items())}
    return rows.withColumns(columns | {n: choice(v, None, seed + 50 + i) for i, (n, v) in enumerate((domains or {}).items())})


def changes(spark: SparkSession, entities: list[str], prop: str, domain: list[str], start: datetime, end: datetime, seed: int = 1, keep: float = 0.3) -> DataFrame:
    """Change points of a property with end dates."""
    grid = time_grid(spark, entities, start, end, "1 day", ts="start_date").where(F.rand(seed) < keep)
    return with_end_dates(grid.withColumn(prop, choice(domain, None, seed + 1)), "entity_id")


@operator("EntityDataGenerator", outputs=("output_item",), kind="source")
def entity_data_generator(df, ctx, ids, output_item=None, parameters=None):
    """Rows for the given ids over the run's window, after those of the frame."""
    start, end = ctx.start or datetime(2024, 1, 1), ctx.end or datetime(2024, 1, 2)
    numeric = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    made = time_series(df.sparkSession, listed(ids), start, end, {n: (0.0, 1.0) for n in numeric}, freq=(parameters or {}).get("freq", "5 minutes"))
    made = made.withColumnsRenamed({"entity_id": ctx.entity, "ts": ctx.timestamp})
    return df.unionByName(made, allowMissingColumns=True)


operator("DeviceDataGenerator", outputs=("output_item",), kind="source")(lambda df, ctx, ids, output_item=None: entity_data_generator(df, ctx, ids, output_item))


def _numbered(df: DataFrame, ctx, factor: int, offsets: DataFrame | None = None) -> DataFrame:
    """``_n``: a row's number within its entity from 0, and ``_block`` of ``factor`` rows; offsets carry on an earlier run."""
    out = df.withColumn("_n", F.row_number().over(series(ctx)) - 1)
    if offsets is not None:
        out = out.join(offsets.select(ctx.entity, F.col("offset").alias("_o")), ctx.entity, "left").withColumn("_n", F.col("_n") + F.coalesce("_o", F.lit(0))).drop("_o")
    return out.withColumn("_block", F.floor(F.col("_n") / factor))


def next_offsets(df: DataFrame, ctx, offsets: DataFrame | None = None) -> DataFrame:
    """How many rows each entity has had, for the next run."""
    seen = df.groupBy(ctx.entity).agg(F.count(F.lit(1)).alias("n"))
    if offsets is None:
        return seen.withColumnRenamed("n", "offset")
    return seen.join(offsets, ctx.entity, "full").select(ctx.entity, (F.coalesce("n", F.lit(0)) + F.coalesce("offset", F.lit(0))).alias("offset"))


@operator("AnomalyGeneratorExtremeValue", inputs=("input_item",), outputs=("output_item",))
def extreme_values(df, ctx, input_item, factor, size, output_item, seed=1, offsets=None):
    """Every ``factor``-th row off by ``size`` standard deviations of its block, 1 at least, up or down."""
    out = _numbered(df, ctx, factor, offsets)
    spread = F.greatest(F.coalesce(F.stddev_samp(input_item).over(Window.partitionBy(ctx.entity, "_block")), F.lit(1.0)), F.lit(1.0))
    sign = F.when(F.pmod(F.xxhash64(ctx.entity, "_n", F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    hit = F.col("_n") % factor == factor - 1
    return out.withColumn(output_item, F.when(hit, F.col(input_item) + sign * spread * size).otherwise(F.col(input_item))).drop("_n", "_block")


@operator("AnomalyGeneratorNoData", inputs=("input_item",), outputs=("output_item",))
def missing_values(df, ctx, input_item, width, factor, output_item, offsets=None):
    """Null in the last ``width`` rows of every ``factor``."""
    out = _numbered(df, ctx, factor, offsets)
    return out.withColumn(output_item, F.when(F.col("_n") % factor < factor - width, F.col(input_item))).drop("_n", "_block")


@operator("AnomalyGeneratorFlatline", inputs=("input_item",), outputs=("output_item",))
def flat_values(df, ctx, input_item, width, factor, output_item, offsets=None):
    """The last ``width`` rows of every ``factor`` hold the first value of that stretch."""
    out = _numbered(df, ctx, factor, offsets)
    flat = F.col("_n") % factor >= factor - width
    held = F.first(F.when(flat, F.struct(F.col(input_item).alias("v"))), ignorenulls=True).over(Window.partitionBy(ctx.entity, "_block").orderBy(ctx.timestamp).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(output_item, F.when(flat, held["v"]).otherwise(F.col(input_item))).drop("_n", "_block")
