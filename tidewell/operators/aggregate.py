"""Aggregation to grains: time, entity and dimensions in any mix.

Every simple aggregator is an aggregate Column, so any number of them over one grain
is one ``groupBy`` with partial aggregation before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.catalog import Context, listed, scope_mask
from tidewell.functions.expressions import compile_expression
from tidewell.functions.scalars import micros, split_frequency

_UNIT_MICROS = {"s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000}


def grain(ts: Column, freq: str, offset: timedelta = timedelta(0)) -> Column:
    """The start of the period of ``freq`` that holds ``ts``, as a timestamp without zone.

    Frequencies are a count and one of s, min, h, D, W (from Sunday), MS, YS; several
    of s to D count from 1970.  ``offset`` is the local time's distance from UTC.
    """
    n, unit = split_frequency(freq)
    local = ts.cast("timestamp_ntz") + F.lit(offset) if offset else ts.cast("timestamp_ntz")
    if unit == "W":
        start = F.date_trunc("week", local + F.lit(timedelta(days=1))).cast("timestamp_ntz") - F.lit(timedelta(days=1))
    elif unit in ("MS", "YS"):
        start = F.date_trunc("month" if unit == "MS" else "year", local)
    elif n == 1:
        start = F.date_trunc({"s": "second", "min": "minute", "h": "hour", "D": "day"}[unit], local)
    else:
        size = n * _UNIT_MICROS[unit]
        floored = F.floor(micros(local) / F.lit(size)) * size
        start = F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), floored / F.lit(1e6))
    start = start.cast("timestamp_ntz")
    return start - F.lit(offset) if offset else start


@dataclass(frozen=True)
class Granularity:
    """A grain: frequency (or none), dimensions, and whether entities stay apart."""

    name: str = "grain"
    freq: str | None = None
    dimensions: tuple[str, ...] = ()
    by_entity: bool = True
    calendar_keys: tuple[str, ...] = ()

    def keys(self, ctx: Context, offset: timedelta = timedelta(0)) -> list[Column]:
        keys = [F.col(ctx.entity)] if self.by_entity else []
        if self.freq:
            keys.append(grain(F.col(ctx.timestamp), self.freq, offset).alias(ctx.timestamp))
        return keys + [F.col(d) for d in (*self.dimensions, *self.calendar_keys)]

    def names(self, ctx: Context) -> list[str]:
        return ([ctx.entity] if self.by_entity else []) + ([ctx.timestamp] if self.freq else []) + [*self.dimensions, *self.calendar_keys]

    def align(self, df: DataFrame, ctx: Context, first: datetime) -> DataFrame:
        """Without the rows of the period that ``first`` cuts into; all rows if it is a period's start."""
        from tidewell.functions.scalars import roll

        start = roll(first, self.freq)
        return df if start == first else df.where(F.col(ctx.timestamp) >= F.lit(roll(first, self.freq, forward=True)))


def _at_least(n: int | None, c: Column, value: Column) -> Column:
    n = 1 if n is None else n
    return value if n <= 0 else F.when(F.count(c) >= n, value)


def _ordered(pick: Callable) -> Callable:
    return lambda c, ts, **_: pick(c, F.when(c.isNotNull(), ts))


#: Aggregators by name, each (value, ts, **options) -> Column.
AGGREGATORS: dict[str, Callable[..., Column]] = {
    "Sum": lambda c, ts, min_count=None: _at_least(min_count, c, F.sum(c)),
    "Minimum": lambda c, ts: F.min(c),
    "Maximum": lambda c, ts: F.max(c),
    "Mean": lambda c, ts: F.avg(c),
    "Median": lambda c, ts: F.median(c),
    "Count": lambda c, ts, min_count=None: _at_least(min_count, c, F.count(c)),
    "DistinctCount": lambda c, ts, min_count=None: _at_least(min_count, c, F.count_distinct(c)),
    "ApproxDistinctCount": lambda c, ts, rsd=0.05: F.approx_count_distinct(c, rsd),
    "StandardDeviation": lambda c, ts: F.stddev_samp(c),
    "Variance": lambda c, ts: F.var_samp(c),
    "Product": lambda c, ts, min_count=None: _at_least(min_count, c, F.product(c)),
    "First": _ordered(F.min_by),
    "Last": _ordered(F.max_by),
    "AggregateWithExpression": lambda c, ts, expression: compile_expression(expression, group=c),
    "AggregateWithCalculation": lambda c, ts, expression: compile_expression(expression, group=c),
    "HelloWorldAggregator": lambda c, ts, expression: compile_expression(expression, group=c),
}

#: Short names of functions over items; these count and sum nothing as 0.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "sum": lambda c, ts: F.coalesce(F.sum(c), F.lit(0)), "count": lambda c, ts: F.count(c), "count_distinct": lambda c, ts: F.count_distinct(c),
    "min": lambda c, ts: F.min(c), "max": lambda c, ts: F.max(c), "mean": lambda c, ts: F.avg(c), "median": lambda c, ts: F.median(c),
    "std": lambda c, ts: F.stddev_samp(c), "var": lambda c, ts: F.var_samp(c), "first": _ordered(F.min_by), "last": _ordered(F.max_by), "product": lambda c, ts: F.product(c),
}


@dataclass(frozen=True)
class Aggregate:
    """One aggregated item: function name, source, output name, options and scope."""

    function: str
    source: str
    name: str
    options: dict = field(default_factory=dict)
    scope: dict | str | None = None

    def column(self, ctx: Context) -> Column:
        c = F.col(self.source)
        if self.scope is not None:
            c = F.when(scope_mask(self.scope, ctx), c)
        run = AGGREGATORS.get(self.function) or FUNCTIONS[self.function]
        return run(c, F.col(ctx.timestamp), **self.options).alias(self.name)


def aggregate(df: DataFrame, ctx: Context, granularity: Granularity, items: list[Aggregate], offset: timedelta = timedelta(0), fill_periods: bool = False) -> DataFrame:
    """All ``items`` in one pass over one grain.

    ``fill_periods`` adds the empty periods of a grain by time alone.
    """
    # group on a projected key, so that the timestamp stays there for first and last
    keyed = df.select("*", *(k.alias(f"_key_{n}") for k, n in zip(granularity.keys(ctx, offset), granularity.names(ctx))))
    keys = [f"_key_{n}" for n in granularity.names(ctx)]
    out = keyed.groupBy(*keys).agg(*(i.column(ctx) for i in items)).withColumnsRenamed({k: k[5:] for k in keys})
    if fill_periods and granularity.names(ctx) == [ctx.timestamp]:
        n, unit = split_frequency(granularity.freq)
        step = {"W": f"{7 * n} days", "MS": f"{n} months", "YS": f"{n} years", "D": f"{n} days", "h": f"{n} hours", "min": f"{n} minutes", "s": f"{n} seconds"}[unit]
        ends = out.agg(F.min(ctx.timestamp).alias("a"), F.max(ctx.timestamp).alias("b"))
        every = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(ctx.timestamp))
        out = every.join(out, ctx.timestamp, "left")
    return out


def aggregate_items(df: DataFrame, ctx: Context, granularity: Granularity, input_items: list[str], aggregation_function: str, output_items: list[str] | None = None) -> DataFrame:
    """One function over several items."""
    names = output_items or [f"{i}_{aggregation_function}" for i in input_items]
    return aggregate(df, ctx, granularity, [Aggregate(aggregation_function, i, n) for i, n in zip(input_items, names)])


def data_aggregator(df: DataFrame, ctx: Context, granularity: Granularity, agg_dict: dict[str, list[str]], names: dict[tuple[str, str], str] | None = None) -> DataFrame:
    names = names or {}
    return aggregate(df, ctx, granularity, [Aggregate(f, i, names.get((i, f), f"{i}_{f}")) for i, fs in agg_dict.items() for f in listed(fs)])


def resample(df: DataFrame, ctx: Context, freq: str, dimensions: list[str] | None = None, agg: dict[str, str] | None = None, default_aggregate: str = "last") -> DataFrame:
    """Every other column to a coarser frequency; those not named by the default function."""
    dims = tuple(dimensions or ())
    items = [c for c in df.columns if c not in (ctx.timestamp, *dims)]
    chosen = agg or {}
    return aggregate(df, ctx, Granularity(freq=freq, dimensions=dims, by_entity=False), [Aggregate(chosen.get(c, default_aggregate), c, c) for c in items])


def complex_aggregate(df: DataFrame, ctx: Context, granularity: Granularity, run: Callable, schema: str) -> DataFrame:
    """A pandas function of each whole group; its rows get the group's keys in front."""
    names = granularity.names(ctx)
    keyed = df.select("*", *(k.alias(f"_key_{n}") for k, n in zip(granularity.keys(ctx), names)))
    types = ", ".join(f"`{n}` {keyed.schema[f'_key_{n}'].dataType.simpleString()}" for n in names)

    def group(pdf):
        out = run(pdf.drop(columns=[f"_key_{n}" for n in names]))
        for i, n in enumerate(names):
            out.insert(i, n, pdf[f"_key_{n}"].iloc[0])
        return out

    return keyed.groupBy(*(f"_key_{n}" for n in names)).applyInPandas(group, f"{types}, {schema}")


# aggregates over the pushed-down query layer


def read_agg(
    table: DataFrame, agg_dict: dict[str, list[str]], agg_outputs: dict[str, list[str]] | None = None, groupby: list[str] | None = None, timestamp: str | None = None,
    time_grain: str | None = None, dimension: DataFrame | None = None, start_ts=None, end_ts=None, entities: list | None = None, filters: dict | None = None,
    deviceid_col: str = "deviceid", end_inclusive: bool = True,
) -> DataFrame:
    """Aggregates by dimensions and time in one plan; the end bound is inclusive here.

    Filters, the join to the dimension and the projection are left to the optimizer,
    which pushes them to the scan.
    """
    from tidewell.sources.tables import scan

    df = scan(table, timestamp_col=timestamp, start_ts=start_ts, end_ts=end_ts, entities=entities, dimension=dimension, filters=filters, deviceid_col=deviceid_col, end_inclusive=end_inclusive)
    keys = [F.col(g) for g in groupby or []]
    ts = F.col(timestamp) if timestamp else F.lit(None)
    if time_grain:
        keys.append(grain(ts, time_grain).alias("_period"))
    out = []
    for item, functions in agg_dict.items():
        for i, f in enumerate(listed(functions)):
            name = (agg_outputs or {}).get(item, [])
            out.append(FUNCTIONS[f](F.col(item), ts).alias(listed(name)[i] if i < len(listed(name)) else f"{item}_{f}"))
    found = df.groupBy(*keys).agg(*out)
    return found.withColumnRenamed("_period", timestamp) if time_grain else found


def query_time_agg(table: DataFrame, column: str, regular_agg: str, time_agg: str, groupby: list[str], timestamp: str, time_grain: str | None = None, output_item: str = "output_item", **options) -> DataFrame:
    """One function across the dimensions at each time, then first or last over time."""
    from tidewell.sources.tables import scan

    df = scan(table, timestamp_col=timestamp, **options)
    each = df.groupBy(*groupby, timestamp).agg(FUNCTIONS[regular_agg](F.col(column), F.col(timestamp)).alias("_value"))
    keys = [*groupby, *([grain(F.col(timestamp), time_grain).alias("_period")] if time_grain else [])]
    out = each.groupBy(*keys).agg(FUNCTIONS[time_agg](F.col("_value"), F.col(timestamp)).alias(output_item))
    return out.withColumnRenamed("_period", timestamp) if time_grain else out


def query_column_aggregate(table: DataFrame, column: str, aggregate: str, timestamp: str | None = None, **options):
    from tidewell.sources.tables import scan

    return scan(table, timestamp_col=timestamp, **options).agg(FUNCTIONS[aggregate](F.col(column), F.col(timestamp) if timestamp else F.lit(None)).alias(f"{column}_{aggregate}"))


def time_interval(start: datetime | None, end: datetime | None, period_type: str, period_count: int = 1) -> tuple[datetime | None, datetime | None]:
    """The missing bound of a window of days, hours, minutes, seconds, weeks, mtd or ytd."""
    if start is not None and end is not None:
        return start, end
    midnight = lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0)
    if period_type in ("mtd", "ytd"):
        end = end or datetime.now()
        return midnight(end).replace(day=1, **({"month": 1} if period_type == "ytd" else {})), end
    delta = timedelta(**{period_type: period_count})
    if start is not None:
        return start, start + delta
    end = end or datetime.now()
    return end - delta, end


# direct aggregators


def time_in_state(df: DataFrame, ctx: Context, granularity: Granularity, state: str, name: str) -> DataFrame:
    """Seconds with the flag ``state`` set per group.

    A row lasts until the group's next one; the last row as long as the interval
    before it.  Groups of one row give 0.
    """
    names = granularity.names(ctx)
    keyed = df.select(F.col(state).cast("boolean").alias("_on"), F.col(ctx.timestamp).alias("_ts"), *(k.alias(f"_key_{n}") for k, n in zip(granularity.keys(ctx), names)))
    keys = [f"_key_{n}" for n in names]
    order = Window.partitionBy(*keys).orderBy("_ts")
    gap = lambda a, b: (micros(b) - micros(a)) / 1e6
    own = gap(F.col("_ts"), F.lead("_ts").over(order))
    lasting = keyed.withColumn("_s", F.coalesce(own, gap(F.lag("_ts").over(order), F.col("_ts")), F.lit(0.0)))
    out = lasting.groupBy(*keys).agg(F.sum(F.when(F.col("_on"), F.col("_s")).otherwise(0.0)).alias(name))
    return out.withColumnsRenamed({k: k[5:] for k in keys})


def occupancy_count(df: DataFrame, ctx: Context, freq: str, raw_count: str, name: str, start=None, end=None) -> DataFrame:
    """The most of each entity's non-negative raw counts per interval, on its whole time grid.

    Empty intervals take the last known value before them (the last of its interval,
    while a filled interval reports its maximum); those before an entity's first are 0.
    """
    value = F.greatest(F.col(raw_count), F.lit(0))
    seen = df.groupBy(F.col(ctx.entity), grain(F.col(ctx.timestamp), freq).alias("_slot")).agg(
        F.max(value).alias("_most"), F.max_by(value, F.when(F.col(raw_count).isNotNull(), F.col(ctx.timestamp))).alias("_last")
    )
    n, unit = split_frequency(freq)
    step = F.expr(f"interval {n} {({'s': 'seconds', 'min': 'minutes', 'h': 'hours', 'D': 'days'})[unit]}")
    spans = seen.groupBy(ctx.entity).agg(F.min("_slot").alias("a"), F.max("_slot").alias("b"))
    lower = F.lit(start).cast("timestamp_ntz") if start else F.col("a")
    upper = F.lit(end).cast("timestamp_ntz") if end else F.col("b")
    grid = spans.select(ctx.entity, F.explode(F.sequence(lower, upper, step)).alias("_slot"))
    known = Window.partitionBy(ctx.entity).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(seen, [ctx.entity, "_slot"], "left").withColumn("_before", F.last("_last", ignorenulls=True).over(known))
    return filled.select(ctx.entity, F.col("_slot").alias(ctx.timestamp), F.coalesce("_most", "_before", F.lit(0)).alias(name))


def occupancy_duration(df: DataFrame, ctx: Context, granularity: Granularity, count_item: str, name: str, interval: timedelta | None = None) -> DataFrame:
    """Time to the next row summed over rows with a count above 0, per group.

    In units of ``interval``, which the last row of a group then takes; in seconds
    without one, and the last row counts for nothing.
    """
    names = granularity.names(ctx)
    keyed = df.select(F.col(count_item).alias("_n"), F.col(ctx.timestamp).alias("_ts"), *(k.alias(f"_key_{n}") for k, n in zip(granularity.keys(ctx), names)))
    keys = [f"_key_{n}" for n in names]
    unit = interval.total_seconds() if interval else 1.0
    lasts = (micros(F.lead("_ts").over(Window.partitionBy(*keys).orderBy("_ts"))) - micros(F.col("_ts"))) / 1e6 / unit
    out = keyed.withColumn("_t", F.coalesce(lasts, F.lit(1.0 if interval else 0.0))).groupBy(*keys).agg(F.sum(F.when(F.col("_n") > 0, F.col("_t")).otherwise(0.0)).alias(name))
    return out.withColumnsRenamed({k: k[5:] for k in keys})


def occupancy_location(df: DataFrame, ctx: Context, granularity: Granularity, x_pos: str, y_pos: str, name: str) -> DataFrame:
    """Per group the JSON text {"data":[{x, y, count}]} of its positions, in order."""
    names = granularity.names(ctx)
    keys = [k.alias(f"_key_{n}") for k, n in zip(granularity.keys(ctx), names)]
    counted = df.where(F.col(x_pos).isNotNull() & F.col(y_pos).isNotNull()).groupBy(*keys, F.col(x_pos).alias("x"), F.col(y_pos).alias("y")).agg(F.count(F.lit(1)).alias("count"))
    listed_ = F.sort_array(F.collect_list(F.struct("x", "y", "count")))
    return counted.groupBy(*(f"_key_{n}" for n in names)).agg(F.to_json(F.struct(listed_.alias("data"))).alias(name)).withColumnsRenamed({f"_key_{n}": n for n in names})


def histogram(df: DataFrame, ctx: Context, granularity: Granularity, source: str, name: str, bins: int = 10) -> DataFrame:
    """A density histogram of each group's values scaled to 0..1, as comma-separated text.

    The text is empty for a group with a null or with one distinct value only.
    """
    names = granularity.names(ctx)
    keyed = df.select(F.col(source).cast("double").alias("_v"), *(k.alias(f"_key_{n}") for k, n in zip(granularity.keys(ctx), names)))
    keys = [f"_key_{n}" for n in names]
    ends = keyed.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count("_v").alias("_n"), F.count(F.lit(1)).alias("_all"))
    bucket = F.least(F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1))
    usable = (F.col("_n") == F.col("_all")) & (F.col("_b") > F.col("_a"))
    group = Window.partitionBy(*keys)
    scaled = keyed.withColumns({"_a": F.min("_v").over(group), "_b": F.max("_v").over(group)})
    counts = scaled.where(F.col("_b") > F.col("_a")).groupBy(*keys, bucket.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    found = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("_m", i.cast("long")), F.lit(0)) * float(bins) / F.col("_n"))
    text = F.concat_ws(",", F.transform(dense, lambda v: F.round(v, 6).cast("string")))
    return ends.join(found, keys, "left").select(*(F.col(k).alias(k[5:]) for k in keys), F.when(usable, text).otherwise("").alias(name))
