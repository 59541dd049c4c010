"""Alerts: conditions, pulses, counted occurrences, gaps in data, and the alert table.

Alert columns are true or null.  The two alerts with memory are one step function
over a time-ordered list of points and a small state, which serves batch runs and
streams alike.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.catalog import Context, listed, operator
from tidewell.functions.expressions import compile_expression


def _true_or_null(condition):
    return F.when(condition, F.lit(True))


@operator("AlertExpression", outputs=("alert_name",), expressions=("expression",), kind="alert")
def alert_expression(df, ctx, expression, alert_name, **_):
    return df.withColumn(alert_name, _true_or_null(compile_expression(expression, ctx.constants)))


operator("Alert", outputs=("name",), expressions=("expression",), kind="alert")(lambda df, ctx, name, expression, sources=None: alert_expression(df, ctx, expression, name))


@operator("AlertExpressionWithFilter", inputs=("dimension_name",), outputs=("alert_name",), expressions=("expression",), kind="alert")
def alert_expression_with_filter(df, ctx, expression, dimension_name, dimension_value, alert_name, **_):
    """1 where the expression holds for the dimension's value, else 0."""
    hit = compile_expression(expression, ctx.constants) & (F.col(dimension_name) == dimension_value)
    return df.withColumn(alert_name, F.coalesce(hit, F.lit(False)).cast("int"))


def pulses(df: DataFrame, ctx: Context, flag: str, name: str, end_name: str | None = None, least: int = 2) -> DataFrame:
    """Per entity, on the first row of each run of ``least`` set flags or more its length, else 0.

    ``end_name`` gets the time of the run's last row there.
    """
    order = Window.partitionBy(ctx.entity).orderBy(ctx.timestamp)
    on = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    runs = df.withColumn("_on", on).withColumn("_run", F.sum(F.when(~F.col("_on"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(ctx.entity, "_run", "_on")
    sized = runs.withColumns({"_n": F.count(F.lit(1)).over(run), "_end": F.max(ctx.timestamp).over(run), "_i": F.row_number().over(run.orderBy(ctx.timestamp))})
    first = F.col("_on") & (F.col("_i") == 1) & (F.col("_n") >= least)
    out = sized.withColumn(name, F.when(first, F.col("_n")).otherwise(F.lit(0)).cast("long"))
    if end_name:
        out = out.withColumn(end_name, F.when(first, F.col("_end")))
    return out.drop("_on", "_run", "_n", "_end", "_i")


@operator("AlertExpressionWithFilterExt", inputs=("dimension_name",), outputs=("alert_name", "alert_end"), expressions=("expression",), kind="alert")
def alert_pulse(df, ctx, expression, dimension_name, dimension_value, alert_name, alert_end=None, pulse_trigger=True, **_):
    """With ``pulse_trigger`` runs of two hits or more, told on their first row."""
    out = alert_expression_with_filter(df, ctx, expression, dimension_name, dimension_value, "_hit")
    if pulse_trigger:
        return pulses(out, ctx, "_hit", alert_name, alert_end).drop("_hit")
    return out.withColumnRenamed("_hit", alert_name)


@operator("AlertOutOfRange", inputs=("input_item",), outputs=("output_alert_upper", "output_alert_lower"), kind="alert")
def alert_out_of_range(df, ctx, input_item, lower_threshold=None, upper_threshold=None, output_alert_upper="output_alert_upper", output_alert_lower="output_alert_lower", **_):
    """Thresholds are inclusive; the alert of one that is not set is false throughout."""
    c = F.col(input_item)
    upper = F.lit(False) if upper_threshold is None else _true_or_null(c >= upper_threshold)
    lower = F.lit(False) if lower_threshold is None else _true_or_null(c <= lower_threshold)
    return df.withColumns({output_alert_upper: upper, output_alert_lower: lower})


@operator("AlertHighValue", inputs=("input_item",), outputs=("alert_name",), kind="alert")
def alert_high_value(df, ctx, input_item, upper_threshold, alert_name="alert_name", **_):
    return df.withColumn(alert_name, _true_or_null(F.col(input_item) >= upper_threshold))


@operator("AlertLowValue", inputs=("input_item",), outputs=("alert_name",), kind="alert")
def alert_low_value(df, ctx, input_item, lower_threshold, alert_name="alert_name", **_):
    return df.withColumn(alert_name, _true_or_null(F.col(input_item) <= lower_threshold))


_SECONDS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400}


def seconds(amount: float | None, unit: str | None) -> float:
    """A duration in seconds; units may be plural and in either case."""
    return 0.0 if amount is None else float(amount) * _SECONDS[(unit or "SECOND").upper().rstrip("S")]


@dataclass
class OccurrenceRule:
    """At least ``least`` occurrences in a window of ``window`` seconds."""

    least: int
    window: float
    sliding: bool = True
    rising: bool = True
    cooldown: float = 0.0


@dataclass
class OccurrenceState:
    """What an entity carries from one run to the next."""

    on: bool = False
    times: list = field(default_factory=list)
    quiet_until: float = float("-inf")

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str | None) -> OccurrenceState:
        return cls(**json.loads(text)) if text else cls()


def count_occurrences(points: list[tuple[float, bool]], rule: OccurrenceRule, state: OccurrenceState) -> list[bool]:
    """Whether each point (seconds, condition), in time order, raises an alert; ``state`` goes on.

    A sliding window holds times after t - window, a tumbling one those of t's own
    window, counted from 1970.  An alert clears the occurrences; the cool-down runs
    from the alert, or from the window's end where it tumbles.
    """
    out = []
    for t, on in points:
        happens = on and not (rule.rising and state.on)
        state.on = on
        if happens:
            state.times.append(t)
        start = t - rule.window if rule.sliding else t // rule.window * rule.window
        state.times = [x for x in state.times if (x > start if rule.sliding else x >= start)]
        fires = happens and len(state.times) >= rule.least and t > state.quiet_until
        if fires:
            state.times = []
            if rule.cooldown:
                state.quiet_until = (t if rule.sliding else start + rule.window) + rule.cooldown
        out.append(fires)
    return out


@operator("AlertByOccurrencesCount", outputs=("alert_name",), expressions=("expression",), kind="alert")
def alert_by_occurrences(df, ctx, expression, min_occurrences, time_window, window_type="SLIDING", window_time_unit="MINUTE", occurrence_mode="RISING EDGE", alert_name="alert_name", cooldown=0, cooldown_time_unit=None, **_):
    """Per entity in time order; only occurrences that can fire are dealt to blocks, and alerts join back."""
    from tidewell.operators.occurrences import occurrence_alerts

    rule = OccurrenceRule(min_occurrences, seconds(time_window, window_time_unit), "SLID" in window_type.upper(), "RISING" in occurrence_mode.upper(), seconds(cooldown, cooldown_time_unit or window_time_unit))
    on = F.coalesce(compile_expression(expression, ctx.constants), F.lit(False))
    fired = occurrence_alerts(df.select(F.col(ctx.entity).alias("_e"), F.col(ctx.timestamp).alias("_t"), on.alias("_on")), rule)
    joined = df.join(fired.withColumn(alert_name, F.lit(True)), (F.col(ctx.entity) == F.col("_e")) & (F.col(ctx.timestamp) == F.col("_t")), "left")
    return joined.drop("_e", "_t")


def no_data_alerts(df: DataFrame, ctx: Context, duration: float, cooldown: float | None = None, registered: datetime | None = None, end: datetime | None = None, entities: DataFrame | None = None, alert_name: str = "no_data_alert") -> DataFrame:
    """Rows (entity, time, alert) at which data has been missing for ``duration`` seconds.

    Gaps lie between an entity's consecutive points, from ``registered`` to ``end``
    where given.  A gap of ``duration`` or more alerts at its start + duration and
    then every ``cooldown`` seconds (default: the duration) strictly before its end.
    ``entities`` adds those without any data.
    """
    points = df.select(F.col(ctx.entity).alias("_e"), F.col(ctx.timestamp).cast("timestamp_ntz").alias("_t")).distinct()
    names = points.select("_e") if entities is None else points.select("_e").unionByName(entities.select(F.col(ctx.entity).alias("_e")))
    for bound in (registered, end):
        if bound is not None:
            points = points.unionByName(names.distinct().withColumn("_t", F.lit(bound).cast("timestamp_ntz")))
    if end is not None:
        points = points.where(F.col("_t") <= F.lit(end))
    gaps = points.distinct().withColumn("_next", F.lead("_t").over(Window.partitionBy("_e").orderBy("_t")))
    wait, again = (F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(s))) for s in (duration, cooldown or duration))
    first = F.col("_t") + wait
    long_ = gaps.where(first < F.col("_next"))
    at = long_.select(F.col("_e").alias(ctx.entity), F.col("_next"), F.explode(F.sequence(first, F.col("_next"), again)).alias(ctx.timestamp))
    return at.where(F.col(ctx.timestamp) < F.col("_next")).select(ctx.entity, ctx.timestamp, F.lit(True).alias(alert_name))


@operator("NoDataAlert", outputs=("alert_name",), kind="alert")
def no_data_alert(df, ctx, duration, duration_unit="MINUTE", cooldown=None, cooldown_unit=None, input_item=None, alert_name="no_data_alert", **_):
    """The frame and, between its rows, those of the missing data alerts."""
    seen = df.where(F.col(input_item).isNotNull()) if input_item else df
    rows = no_data_alerts(seen, ctx, seconds(duration, duration_unit), seconds(cooldown, cooldown_unit or duration_unit) or None, ctx.start, min((t for t in (ctx.end, ctx.launch) if t), default=None), alert_name=alert_name)
    return df.unionByName(rows, allowMissingColumns=True)


def alert_changes(computed: DataFrame, stored: DataFrame, keys: list[str], status: str = "domain_status", touched: str = "last_updated_by", system: str = "SYSTEM") -> DataFrame:
    """What the alert table has to take over, with ``change`` new, stale or reactivated.

    ``computed`` is one row per alert (repeats count once); ``stored`` the table's
    rows of the same window.  A stored alert that is no longer computed becomes
    Resolved, a resolved one computed again New.  Alerts that a user has touched stay.
    """
    now = computed.select(*keys).distinct().withColumn("_now", F.lit(True))
    old = stored.select(*keys, F.col(status).alias("_status"), F.col(touched).alias("_by")).withColumn("_old", F.lit(True))
    both = now.join(old, keys, "full")
    free = F.col("_by").isNull() | (F.col("_by") == system)
    change = (
        F.when(F.col("_old").isNull(), "new")
        .when(free & F.col("_now").isNull() & (F.col("_status") != "Resolved"), "stale")
        .when(free & F.col("_now").isNotNull() & (F.col("_status") == "Resolved"), "reactivated")
    )
    out = both.withColumn("change", change).where(F.col("change").isNotNull())
    return out.select(*keys, "change", F.when(F.col("change") == "stale", "Resolved").otherwise("New").alias(status))


def computed_alerts(df: DataFrame, ctx: Context, alert_names: list[str], entity_type: str) -> DataFrame:
    """Set alert columns as rows of the alert table: entity type, item, entity, time."""
    long = df.unpivot([ctx.entity, ctx.timestamp], listed(alert_names), "data_item_name", "_on")
    on = long.where(F.col("_on"))
    return on.select(F.lit(entity_type).alias("entity_type_id"), "data_item_name", F.col(ctx.entity).alias("entity_id"), F.col(ctx.timestamp).alias("timestamp")).distinct()
