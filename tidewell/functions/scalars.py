"""Date, text and rate functions of one row, and small helpers on the driver."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidewell.catalog import listed, operator

DAY_MICROS = 86_400_000_000


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp of either kind, read in UTC for plain ones."""
    return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def days_between(earlier: Column, later: Column) -> Column:
    return (micros(later) - micros(earlier)) / float(DAY_MICROS)


@operator("DateDifference", inputs=("date_1", "date_2"), outputs=("num_days",))
def date_difference(df, ctx, date_1=None, date_2=None, num_days="num_days"):
    """Fractional days from date_1 to date_2; a date not given is the event's time."""
    a, b = (F.col(d or ctx.timestamp) for d in (date_1, date_2))
    return df.withColumn(num_days, days_between(a, b))


@operator("DateDifferenceConstant", inputs=("date_1",), outputs=("num_days",))
def date_difference_constant(df, ctx, date_1, date_constant, num_days="num_days"):
    value = ctx.constants.get(date_constant, date_constant)
    return df.withColumn(num_days, days_between(F.col(date_1 or ctx.timestamp), F.lit(value).cast("timestamp_ntz")))


@operator("DateDifferenceReference", inputs=("date_1",), outputs=("num_days",))
def date_difference_reference(df, ctx, date_1, ref_date, num_days="num_days"):
    """A whole number is seconds since 1970."""
    ref = datetime(1970, 1, 1) + timedelta(seconds=ref_date) if isinstance(ref_date, int) else ref_date
    return df.withColumn(num_days, days_between(F.col(date_1 or ctx.timestamp), F.lit(ref).cast("timestamp_ntz")))


@operator("ComputationsOnStringArray", inputs=("input_str",), outputs=("output_item",))
def computations_on_string_array(df, ctx, input_str, output_item="output_item"):
    part = lambda i: F.try_element_at(F.split(F.col(input_str), ","), F.lit(i)).try_cast("double")
    return df.withColumn(output_item, F.lit(0.5) + part(1) * 0.25 - part(2) * 0.1 + part(3) * 0.05)


@operator("MsiOccupancyRate", inputs=("occupancy_count", "capacity"), outputs=("occupancy_rate",))
def occupancy_rate(df, ctx, occupancy_count, capacity, occupancy_rate="occupancy_rate"):
    share = F.col(occupancy_count) / F.nullif(F.col(capacity), F.lit(0)) * 100
    return df.withColumn(occupancy_rate, F.bround(share, 2))


def day_minutes(text: Column, default: float) -> Column:
    """Minutes from midnight of an HH:MM text; the default where it is missing or no time."""
    found = F.split(text, ":")
    value = F.try_element_at(found, F.lit(1)).try_cast("double") * 60 + F.try_element_at(found, F.lit(2)).try_cast("double")
    return F.coalesce(value, F.lit(default))


@operator("MsiFrequencyRate", inputs=("occupancy_per_day", "office_hour_start", "office_hour_end"), outputs=("frequency_rate",))
def frequency_rate(df, ctx, occupancy_per_day, office_hour_start=None, office_hour_end=None, frequency_rate="frequency_rate"):
    """Occupied minutes of the office hours in percent; -1 where these are empty.

    The office hours of an entity are those of its first row.
    """
    first = Window.partitionBy(ctx.entity).orderBy(ctx.timestamp)
    at = lambda name, default: day_minutes(F.first(F.col(name)).over(first), default) if name else F.lit(default)
    available = at(office_hour_end, 1440.0) - at(office_hour_start, 0.0)
    return df.withColumn(frequency_rate, F.when(available <= 0, F.lit(-1.0)).otherwise(F.col(occupancy_per_day) / available * 100))


@operator("MsiOccupancyCountByUnit", inputs=("occupancy_count", "weights"), outputs=("weighted_occupancy_counts",))
def occupancy_by_unit(df, ctx, occupancy_count, weights, weighted_occupancy_counts):
    """The count shared over the units whose flag is set, on those units."""
    set_ = {w: F.coalesce(F.col(w).cast("boolean"), F.lit(False)) for w in listed(weights)}
    units = sum((c.cast("int") for c in set_.values()), F.lit(0))
    share = F.col(occupancy_count) / F.nullif(units, F.lit(0))
    return df.withColumns({n: F.when(c, share) for n, c in zip(listed(weighted_occupancy_counts), set_.values())})


# helpers on the driver

_OLD_NAMES = {"S": "s", "T": "min", "H": "h", "AS": "YS"}
_ORDER = ["s", "min", "h", "D", "W", "MS", "YS"]


def split_frequency(freq: str) -> tuple[int, str]:
    digits = "".join(ch for ch in freq if ch.isdigit())
    unit = freq[len(digits) :].split("-")[0]
    return int(digits or 1), _OLD_NAMES.get(unit, unit)


def normalise_frequency(freq: str) -> str:
    n, unit = split_frequency(freq)
    return f"{n if n > 1 else ''}{unit}"


def compare_frequency(a: str, b: str) -> int:
    """Negative where ``a`` is the finer grain, 0 where they are equal."""
    (n, u), (m, v) = split_frequency(a), split_frequency(b)
    x, y = (_ORDER.index(u), n), (_ORDER.index(v), m)
    return (x > y) - (x < y)


def max_frequency(frequencies: list[str]) -> str | None:
    best = None
    for f in frequencies:
        best = f if best is None or compare_frequency(f, best) > 0 else best
    return best


def frequency_delta(freq: str) -> timedelta:
    n, unit = split_frequency(freq)
    return n * {"s": timedelta(seconds=1), "min": timedelta(minutes=1), "h": timedelta(hours=1), "D": timedelta(days=1), "W": timedelta(weeks=1), "MS": timedelta(days=31), "YS": timedelta(days=366)}[unit]


def backtrack_of(freq: str) -> dict[str, int]:
    """The default look-back of a grain: one whole period."""
    n, unit = split_frequency(freq)
    name = {"s": "seconds", "min": "minutes", "h": "hours", "D": "days", "W": "weeks", "MS": "months", "YS": "years"}[unit]
    return complete_backtrack({name: n})


def complete_backtrack(backtrack: dict[str, int]) -> dict[str, int]:
    """The same with all finer fields set back to the period's start."""
    order = ["years", "months", "weeks", "days", "hours", "minutes", "seconds"]
    least = max((order.index(k) for k in backtrack if k in order), default=-1)
    zero = {"months": "month", "days": "day", "hours": "hour", "minutes": "minute", "seconds": "second"}
    return backtrack | {zero[k]: (1 if zero[k] in ("month", "day") else 0) for k in order[least + 1 :] if k in zero}


def roll(ts: datetime, freq: str, forward: bool = False) -> datetime:
    """The start of the period that holds ``ts``, or of the next one; weeks start on Sunday."""
    n, unit = split_frequency(freq)
    day = ts.replace(hour=0, minute=0, second=0, microsecond=0)
    start = {
        "s": ts.replace(microsecond=0), "min": ts.replace(second=0, microsecond=0), "h": ts.replace(minute=0, second=0, microsecond=0), "D": day,
        "W": day - timedelta(days=(day.weekday() + 1) % 7), "MS": day.replace(day=1), "YS": day.replace(month=1, day=1),
    }[unit]
    if not forward:
        return start
    if unit == "MS":
        return (start + timedelta(days=32)).replace(day=1)
    return start.replace(year=start.year + 1) if unit == "YS" else start + frequency_delta(unit)


def adjust_probabilities(values: list[float]) -> list[float]:
    total = sum(values)
    if total <= 0:
        raise ValueError("the sum of probabilities must be positive")
    return [v / total for v in values]


def window_and_overlap(size: int, most: int = 24) -> tuple[int, int]:
    size = min(max(int(size), 1), most)
    return size, size // 2 if size > 1 else 0
