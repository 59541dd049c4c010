"""Shift calendars: which shift a time falls in, and intervals cut at shift boundaries."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.catalog import operator
from tidewell.functions.scalars import micros
from tidewell.operators.joins import small

HOUR = 3_600_000_000


@dataclass(frozen=True)
class Shift:
    """Hours from midnight, half-open; an end past 24 runs into the next day.

    ``to_next`` counts the hours of an overnight shift to the day it ends on.
    """

    name: str
    start: float
    end: float
    to_next: bool = False

    def pieces(self) -> list[tuple[float, float, int]]:
        """(from hour, to hour, days from the row's date to the shift's day), within one day each."""
        end = self.end if self.end > self.start else self.end + 24
        if end <= 24:
            return [(self.start, end, 0)]
        shift = 1 if self.to_next else 0
        return [(self.start, 24.0, shift), (0.0, end - 24, shift - 1)]


def shift_plan(definition: dict[str, tuple[float, float]], to_next: bool = False) -> list[Shift]:
    return [Shift(str(k), float(a), float(b), to_next) for k, (a, b) in definition.items()]


def _plus(c: Column, micros_: Column | int) -> Column:
    return c.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(micros_) / F.lit(1e6) if isinstance(micros_, int) else micros_ / F.lit(1e6))


def shift_of(ts: Column, shifts: list[Shift]) -> Column:
    """A struct (shift_day, shift_id, start, end, hour_no) by a chain of conditions; null if in none."""
    midnight = F.date_trunc("day", ts).cast("timestamp_ntz")
    passed = micros(ts) - micros(midnight)
    out = None
    for s in shifts:
        length = int(((s.end if s.end > s.start else s.end + 24) - s.start) * HOUR)
        for a, b, days in s.pieces():
            into_next = a == 0.0 and s.start != 0.0
            start = _plus(midnight, int(s.start * HOUR) - (24 * HOUR if into_next else 0))
            what = F.struct(
                _plus(midnight, days * 24 * HOUR).alias("shift_day"), F.lit(s.name).alias("shift_id"), start.alias("shift_start"),
                _plus(start, length).alias("shift_end"), F.floor((micros(ts) - micros(start)) / HOUR).cast("int").alias("hour_no"),
            )
            inside = (passed >= int(a * HOUR)) & (passed < int(b * HOUR))
            out = F.when(inside, what) if out is None else out.when(inside, what)
    return out


@operator("IdentifyShiftFromTimestamp", inputs=("timestamp",), outputs=("shift_day", "shift_id", "shift_start", "shift_end", "hour_no"))
def identify_shift(df, ctx, shifts, timestamp=None, shift_day="shift_day", shift_id="shift_id", shift_start="shift_start", shift_end="shift_end", hour_no="hour_no", cross_day_to_next=False):
    out = df.withColumn("_shift", shift_of(F.col(timestamp or ctx.timestamp), shift_plan(shifts, cross_day_to_next)))
    names = {shift_day: "shift_day", shift_id: "shift_id", shift_start: "shift_start", shift_end: "shift_end", hour_no: "hour_no"}
    return out.withColumns({k: F.col(f"_shift.{v}") for k, v in names.items()}).drop("_shift")


def calendar(spark: SparkSession, first: datetime, last: datetime, shifts: list[Shift]) -> DataFrame:
    """Shift rows from the day before ``first`` to the day after ``last``."""
    a, b = (d.replace(hour=0, minute=0, second=0, microsecond=0) for d in (first - timedelta(days=1), last + timedelta(days=1)))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"), F.expr("interval 1 day"))).alias("d"))
    each = F.array(*(
        F.struct(
            _plus(F.col("d"), 24 * HOUR if s.to_next and s.end > 24 else 0).alias("shift_day"), F.lit(s.name).alias("shift_id"),
            _plus(F.col("d"), int(s.start * HOUR)).alias("shift_start_date"), _plus(F.col("d"), int((s.end if s.end > s.start else s.end + 24) * HOUR)).alias("shift_end_date"),
        )
        for s in shifts
    ))
    return days.select(F.explode(each).alias("x")).select("x.*")


@operator("ShiftCalendar", outputs=("period_start_date", "period_end_date", "shift_day", "shift_id"))
def shift_calendar(df, ctx, shift_definition, period_start_date="shift_start_date", period_end_date="shift_end_date", shift_day="shift_day", shift_id="shift_id", check_end=False):
    """The last shift begun at or before each row; with ``check_end`` none in gaps after its end.

    The calendar repeats every day, so the last shift is found by arithmetic: the
    largest start of day at or before the row's, else the last one of the day before.
    """
    shifts = sorted(shift_plan(shift_definition), key=lambda s: s.start)
    ts = F.col(ctx.timestamp)
    midnight = F.date_trunc("day", ts).cast("timestamp_ntz")
    passed = micros(ts) - micros(midnight)

    def begun(s: Shift, back: int):
        day = _plus(midnight, -back * 24 * HOUR)
        end = s.end if s.end > s.start else s.end + 24
        return F.struct(day.alias("d"), F.lit(s.name).alias("i"), _plus(day, int(s.start * HOUR)).alias("a"), _plus(day, int(end * HOUR)).alias("b"))

    found = begun(shifts[-1], 1)
    for s in shifts:
        found = F.when(passed >= int(s.start * HOUR), begun(s, 0)).otherwise(found)
    out = df.withColumn("_shift", found)
    if check_end:
        out = out.withColumn("_shift", F.when(ts < F.col("_shift.b"), F.col("_shift")))
    return out.withColumns({period_start_date: F.col("_shift.a"), period_end_date: F.col("_shift.b"), shift_day: F.col("_shift.d"), shift_id: F.col("_shift.i")}).drop("_shift")


def tag_by_calendar(df: DataFrame, ctx, table: DataFrame) -> DataFrame:
    """Each row with the last row begun of a calendar table that holds for all entities.

    Calendar rows are dealt by the days that they hold for, the last one up to the
    latest time in ``df``, so the rows of a day need not meet in one task.
    """
    items = ["shift_day", "shift_id", "shift_start_date", "shift_end_date"]
    latest = df.agg(F.max(ctx.timestamp)).first()[0]
    # a row per shift of the calendar, which does not grow with the readings
    begun = table.select(*items, F.col("shift_start_date").alias("_from"), F.lead("shift_start_date").over(Window.orderBy("shift_start_date")).alias("_to"))
    until = F.greatest(F.col("_from"), F.coalesce("_to", F.lit(latest).cast("timestamp_ntz")))
    days = begun.where("_from is not null").select("*", F.explode(F.sequence(F.to_date("_from"), F.to_date(until))).alias("_day"))
    now = F.col(ctx.timestamp)
    holds = (F.to_date(now) == F.col("_day")) & (now >= F.col("_from")) & (F.col("_to").isNull() | (now < F.col("_to")))
    return df.join(small(days), holds, "left").drop("_from", "_to", "_day")


def split_by_shifts(df: DataFrame, start: str, end: str, shifts: list[Shift]) -> DataFrame:
    """A row per shift that an interval row meets, cut to the shift's bounds.

    An interval without an end is tagged with its start's shift; one without a start
    gets nulls, as do stretches that no shift covers, which yield no row unless the
    whole interval is uncovered.  Days are made from each row alone, without a join.
    """
    lower, upper = F.col(start).cast("timestamp_ntz"), F.col(end).cast("timestamp_ntz")
    days = F.sequence(_plus(F.date_trunc("day", lower), -24 * HOUR), F.date_trunc("day", upper).cast("timestamp_ntz"), F.expr("interval 1 day"))
    per_day = lambda d: F.array(*(
        F.struct(
            _plus(d, 24 * HOUR if s.to_next and s.end > 24 else 0).alias("shift_day"), F.lit(s.name).alias("shift_id"),
            F.greatest(lower, _plus(d, int(s.start * HOUR))).alias("shift_start"), F.least(upper, _plus(d, int((s.end if s.end > s.start else s.end + 24) * HOUR))).alias("shift_end"),
        )
        for s in shifts
    ))
    met = F.filter(F.flatten(F.transform(days, per_day)), lambda x: x["shift_start"] < x["shift_end"])
    tag = shift_of(lower, shifts)
    single = F.array(F.struct(tag["shift_day"].alias("shift_day"), tag["shift_id"].alias("shift_id"), lower.alias("shift_start"), upper.alias("shift_end")))
    pieces = F.when(lower.isNull() | upper.isNull() | (F.size(met) == 0), single).otherwise(met)
    return df.withColumn("_x", F.explode(pieces)).select(*df.columns, "_x.*")


@operator("SplitDataByActiveShifts", inputs=("start_timestamp", "end_timestamp"), outputs=("shift_day", "shift_id", "shift_start", "shift_end"), kind="source")
def split_data_by_active_shifts(df, ctx, start_timestamp, end_timestamp, shifts, ids=None, shift_day="shift_day", shift_id="shift_id", shift_start="shift_start", shift_end="shift_end", cross_day_to_next=False):
    out = split_by_shifts(df, start_timestamp, end_timestamp, shift_plan(shifts, cross_day_to_next))
    return out.withColumnsRenamed({"shift_day": shift_day, "shift_id": shift_id, "shift_start": shift_start, "shift_end": shift_end})
