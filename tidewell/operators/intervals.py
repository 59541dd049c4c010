"""Intervals in time: overlap joins, property histories, and who is last opened and still open.

An overlap join deals both sides to time buckets of a few widths.  A row's own width
is the least at which it covers no more than ``COVER`` buckets, so long and open
intervals cost as little as short ones; it is also dealt to all wider widths, where it
covers two at most.  A pair meets at the wider of both own widths and is kept in the
bucket in which its overlap begins, so each pair comes once and a busy entity is
spread over its buckets.

Overlapping properties are cut into pieces by a sweep over opens and closes.  An
entity's time is cut into blocks of about ``BLOCK`` intervals that sweep apart.  What
a block needs from before it are the intervals that end in it (each ends in one) and,
of those that span it whole, the one opened last.
"""

from __future__ import annotations

import heapq
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.catalog import operator
from tidewell.functions.scalars import micros
from tidewell.operators.joins import asof_join

#: Buckets that a row may cover at its own width, and how much wider the next width is.
COVER, STEP = 16, 16
HOUR = 3_600_000_000
#: Intervals that open in a block of the sweep, and cells of an entity's time by which blocks are cut.
BLOCK, CELLS = 50_000, 4096


def _bounds(df: DataFrame, first: str, last: str) -> tuple[int | None, int | None, int | None]:
    low, high = micros(F.col(first).cast("timestamp_ntz")), micros(F.col(last).cast("timestamp_ntz"))
    return df.agg(F.min(F.least(low, high)), F.max(F.greatest(low, high)), F.avg(F.abs(high - low)).cast("long")).first()


def _dealt(df: DataFrame, low: str, high: str, widths: list[int], side: str) -> DataFrame:
    """A row for each width ``_w`` from the row's own (``_own_``) on, and for each bucket ``_b`` that it covers there."""
    covered = lambda w: F.expr(f"greatest({low}, {high}) div {w} - least({low}, {high}) div {w}")
    own = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        own = F.when(covered(widths[i]) < COVER, i).otherwise(own)
    width = F.element_at(F.array(*(F.lit(w).cast("long") for w in widths)), F.col("_w") + 1)
    at = df.withColumn(f"_own_{side}", own).withColumn("_w", F.explode(F.sequence(F.col(f"_own_{side}"), F.lit(len(widths) - 1))))
    return at.withColumn("_width", width).withColumn("_b", F.explode(F.expr(f"sequence(least({low}, {high}) div _width, greatest({low}, {high}) div _width)")))


def overlap_join(windows: DataFrame, intervals: DataFrame, keys: list[str], window: tuple[str, str], interval: tuple[str, str]) -> DataFrame:
    """Each window with each interval of its keys that overlaps it: columns of both, ``keys`` once.

    An interval overlaps if it ends at or after the window's start and starts before
    the window's end.  A null start or end is open.  Null keys meet nothing.  Columns
    of the intervals besides the keys must have names of their own.
    """
    clash = (set(windows.columns) & set(intervals.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    (a_low, a_high, a_mean), (b_low, b_high, b_mean) = _bounds(windows, *window), _bounds(intervals, *interval)
    low, high = (f([x for x in found if x is not None], default=0) for f, found in ((min, (a_low, b_low)), (max, (a_high, b_high))))
    low, high = low - 1, high + 1  # open ends reach beyond all others
    widths = [max(HOUR // 60, min(x for x in (a_mean or HOUR, b_mean or HOUR)))]
    while (high - low) // widths[-1] >= COVER:
        widths.append(widths[-1] * STEP)
    reach = lambda c, open_: F.coalesce(micros(F.col(c).cast("timestamp_ntz")), F.lit(open_)) - F.lit(low)
    left = windows.withColumns({"_ws": reach(window[0], low), "_we": reach(window[1], high)})
    right = intervals.withColumns({"_is": reach(interval[0], low), "_ie": reach(interval[1], high)})
    left = _dealt(left, "_ws", "_we", widths, "a").drop("_width")
    right = _dealt(right, "_is", "_ie", widths, "b")
    met = left.join(right, [*keys, "_w", "_b"])
    begins = F.expr("greatest(_ws, _is) div _width")
    pair = (F.col("_w") == F.greatest("_own_a", "_own_b")) & (F.col("_ie") >= F.col("_ws")) & (F.col("_is") < F.col("_we")) & (begins == F.col("_b"))
    return met.where(pair).drop("_w", "_b", "_width", "_ws", "_we", "_is", "_ie", "_own_a", "_own_b")


def scd_data(table: DataFrame, entity: str, start: datetime | None = None, end: datetime | None = None, entities: list | None = None, start_name: str = "start_date", end_name: str = "end_date") -> DataFrame:
    """The rows of a property table that are valid in [start, end); null ends are open.  The filters reach the scan."""
    if start is not None:
        table = table.where(F.col(end_name).isNull() | (F.col(end_name) >= F.lit(start)))
    if end is not None:
        table = table.where(F.col(start_name).isNull() | (F.col(start_name) < F.lit(end)))
    return table.where(F.col(entity).isin(*entities)) if entities is not None else table


def scd_history(windows: DataFrame, tables: dict[str, DataFrame], entity: str, window: tuple[str, str], start_name: str = "start_date", end_name: str = "end_date") -> DataFrame:
    """The values of several properties over each window: its columns, property, value (text), valid_from, valid_to.

    ``tables`` maps a property, which is also its column, to its table.  Windows
    without a value give no row.
    """
    history = None
    for name, table in tables.items():
        rows = table.select(entity, F.lit(name).alias("property"), F.col(name).cast("string").alias("value"), F.col(start_name).alias("valid_from"), F.col(end_name).alias("valid_to"))
        history = rows if history is None else history.unionByName(rows)
    return overlap_join(windows, history, [entity], window, ("valid_from", "valid_to"))


@operator("SCDHistory", outputs=("output_items",), kind="source")
def scd_history_step(df, ctx, table_names, start_item=None, end_item=None, start_name="start_date", end_name="end_date", output_items=None):
    """One row for each row of the frame and each property value valid in its window.

    ``table_names`` maps properties to tables; the window is [start_item, end_item),
    by default the row's time alone.
    """
    tables = {p: ctx.table(df.sparkSession, t) for p, t in table_names.items()}
    if start_item is None:
        at = F.col(ctx.timestamp).cast("timestamp_ntz")
        point = df.withColumns({"_from": at, "_to": at + F.expr("interval 1 microsecond")})
        return scd_history(point, tables, ctx.entity, ("_from", "_to"), start_name, end_name).drop("_from", "_to")
    return scd_history(df, tables, ctx.entity, (start_item, end_item), start_name, end_name)


# the last opened that is still open


def last_opened(starts: np.ndarray, ends: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times at which the winner changes, and its index from then on (-1: none is open).

    Of the open intervals, start <= t < end, that of the highest rank wins.  Each
    enters and leaves a heap once.
    """
    order = np.argsort(starts, kind="stable")
    cuts = np.unique(np.concatenate((starts, ends)))
    heap: list[tuple[int, int]] = []
    winner, at = np.full(len(cuts), -1, np.int64), 0
    for c, cut in enumerate(cuts):
        while at < len(order) and starts[order[at]] <= cut:
            heapq.heappush(heap, (-int(ranks[order[at]]), int(order[at])))
            at += 1
        while heap and ends[heap[0][1]] <= cut:
            heapq.heappop(heap)
        if heap:
            winner[c] = heap[0][1]
    changed = np.ones(len(cuts), bool)
    changed[1:] = winner[1:] != winner[:-1]
    return cuts[changed], winner[changed]


def _swept(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block's intervals, clipped to it, to its pieces; the later (_o, _p) outranks."""
    pdf = pdf.sort_values(["_o", "_p"], na_position="first", kind="stable")
    values = pdf["_p"].to_numpy(object)
    cuts, winner = last_opened(pdf["_s"].to_numpy(np.int64), pdf["_x"].to_numpy(np.int64), np.arange(len(pdf)))
    return pd.DataFrame({"_e": pdf["_e"].iloc[0], "_c": cuts, "_open": winner >= 0, "_p": [values[w] if w >= 0 else None for w in winner]})


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Intervals (_e, _s, _x in microseconds, _p) cut into pieces: from _c on the entity has _p, null where none is open.

    Of several open ones the last by (_s, _p) wins.  Empty intervals are left out.
    """
    rows = rows.where("_s < _x and _e is not null")
    # blocks hold about ``block`` starts: cells of an entity's time are counted, its rows aren't sorted
    extent = rows.groupBy("_e").agg(F.min("_s").alias("_low"), F.expr(f"(max(_x) - min(_s)) div {CELLS} + 1").alias("_cw"))
    celled = rows.join(extent, "_e").withColumns({"_cs": F.expr("(_s - _low) div _cw"), "_cx": F.expr("(_x - 1 - _low) div _cw")})
    counts = celled.groupBy("_e", "_cs").count()
    before = F.sum("count").over(Window.partitionBy("_e").orderBy("_cs").rowsBetween(Window.unboundedPreceding, -1))
    numbered = counts.select("_e", F.col("_cs").alias("_cell"), F.coalesce(before, F.lit(0)).alias("_n"))
    firsts = numbered.groupBy("_e", F.floor(F.col("_n") / block).alias("_k")).agg(F.min("_cell").alias("_cell"))
    limits = firsts.groupBy("_e").agg(F.array_sort(F.collect_list("_cell")).alias("_cells"))  # at most CELLS numbers
    number = lambda c: F.size(F.filter("_cells", lambda x: x <= F.col(c))) - 1
    placed = celled.join(limits, "_e").withColumns({"_bs": number("_cs"), "_bx": number("_cx")})
    start = lambda b: F.col("_low") + F.element_at("_cells", b + 1) * F.col("_cw")
    closing = F.when(F.col("_b") + 1 < F.size("_cells"), start(F.col("_b") + 1))
    clipped = ["_e", "_b", F.when(F.col("_b") > F.col("_bs"), start(F.col("_b"))).otherwise(F.col("_s")).alias("_s"), F.least("_x", closing).alias("_x"), F.col("_s").alias("_o"), "_p"]
    ends = placed.withColumn("_b", F.explode(F.array_distinct(F.array("_bs", "_bx")))).select(*clipped)
    # of the intervals that span a block whole only the one opened last can win there; a span of blocks is two spans of 2 ** _j that may overlap
    spans = placed.where("_bx > _bs + 1").withColumn("_j", F.floor(F.log2(F.col("_bx") - F.col("_bs") - 1)).cast("int"))
    halves = F.array(F.col("_bs") + 1, F.col("_bx") - F.expr("shiftleft(1, _j)"))
    best = F.max(F.struct("_s", "_p")).alias("_best")
    doubled = spans.withColumn("_i", F.explode(F.array_distinct(halves))).groupBy("_e", "_j", "_i").agg(best)
    latest = doubled.withColumn("_b", F.explode(F.expr("sequence(_i, _i + shiftleft(1, _j) - 1)"))).groupBy("_e", "_b").agg(F.max("_best").alias("_best"))
    whole = latest.join(extent, "_e").join(limits, "_e").select("_e", "_b", start(F.col("_b")).alias("_s"), start(F.col("_b") + 1).alias("_x"), F.col("_best._s").alias("_o"), F.col("_best._p").alias("_p"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    swept = ends.unionByName(whole).groupBy("_e", "_b").applyInPandas(_swept, f"_e {kinds['_e']}, _c long, _open boolean, _p {kinds['_p']}")
    # where a block closes and the next one goes on, the next one's piece counts
    return swept.groupBy("_e", "_c").agg(F.max(F.struct("_open", "_p"))["_p"].alias("_p"))


def interval_default(left: DataFrame, right: DataFrame, entity: str, ts: str, start: str, end: str, prop: str, name: str, default, block: int = BLOCK) -> DataFrame:
    """The property of the interval start <= ts < end; of several, the last by (start, property).

    Overlaps are first cut into pieces with one winner each, so that an as-of join
    can look the piece up: no row meets more than one interval.
    """
    rows = right.select(F.col(entity).alias("_e"), micros(F.col(start)).alias("_s"), micros(F.col(end)).alias("_x"), F.col(prop).alias("_p"))
    at = F.expr("timestampadd(MICROSECOND, _c, timestamp_ntz'1970-01-01 00:00:00')")
    cut = pieces(rows, block).select(F.col("_e").alias(entity), at.alias("_c"), F.struct(F.col("_p").alias("v")).alias("_w"))
    joined = asof_join(left, cut, entity, ts, "_c", ["_w"])
    return joined.withColumn(name, F.coalesce(F.col("_w.v"), F.lit(default))).drop("_w")


@operator("SCDLookupWithDefault", outputs=("output_item",))
def scd_lookup_with_default(df, ctx, table_name, dimension_name, default_value, output_item=None, entity_name=None, start_name="start_date", end_name="end_date"):
    table = ctx.table(df.sparkSession, table_name).withColumnRenamed(entity_name or ctx.entity, ctx.entity)
    return interval_default(df, table, ctx.entity, ctx.timestamp, start_name, end_name, dimension_name, output_item or dimension_name, default_value)
