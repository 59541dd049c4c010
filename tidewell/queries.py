"""Registered queries over the driver's tables, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog import Context, Step
from tidewell.functions import metrics as M
from tidewell.functions.quality import quality_checks
from tidewell.operators import activities as A
from tidewell.operators import alerts as L
from tidewell.operators import intervals as I
from tidewell.operators import joins as J
from tidewell.operators import models as ML
from tidewell.operators import shifts as S
from tidewell.operators import windows as W
from tidewell.operators.aggregate import (
    Aggregate, Granularity, aggregate, aggregate_items, complex_aggregate, data_aggregator, histogram, occupancy_count, occupancy_duration, occupancy_location, query_column_aggregate, query_time_agg, read_agg, resample, time_in_state,
)
from tidewell.plans.pipeline import CalcPipeline, EntityType
from tidewell.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CTX = Context("user_id", "ts")
DAY = Granularity("day", "D")
SHIFTS = {"1": (5.5, 14.0), "2": (14.0, 21.0), "3": (21.0, 29.5)}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", *(columns or ("event_id", "value", "event_type", "props")))


# aggregates


def _simple(name: str, function: str, sql: str, item: str = "value", wrap=None, **options):
    def run(spark, sf):
        df = events(spark, sf, "value", "event_type")
        out = aggregate(df, CTX, DAY, [Aggregate(function, item, "result", options)])
        return out.withColumn("result", F.round("result", 6)) if wrap else out

    query(name, f"select user_id, date_trunc('day', ts)::timestamp as ts, {f'round({sql}, 6)' if wrap else sql} as result from events group by 1, 2")(run)


_simple("agg_daily_mean", "Mean", "avg(value)", wrap=True)
_simple("agg_daily_sum_mincount", "Sum", "case when count(value) >= 2 then sum(value) end", wrap=True, min_count=2)
_simple("agg_daily_min", "Minimum", "min(value)")
_simple("agg_daily_max", "Maximum", "max(value)")
_simple("agg_daily_count", "Count", "case when count(value) >= 1 then count(value) end")
_simple("agg_daily_distinct", "DistinctCount", "case when count(event_type) >= 1 then count(distinct event_type) end", "event_type")
_simple("agg_daily_std", "StandardDeviation", "stddev_samp(value)", wrap=True)
_simple("agg_daily_var", "Variance", "var_samp(value)", wrap=True)
_simple("agg_daily_median", "Median", "median(value)", wrap=True)
_simple("agg_range_expr", "AggregateWithExpression", "max(value) - min(value)", wrap=True, expression="x.max() - x.min()")
_simple("agg_group_calculation", "AggregateWithCalculation", "sum(value) / count(value) + min(value)", wrap=True, expression="${GROUP}.sum() / ${GROUP}.count() + ${GROUP}.min()")


@query("agg_daily_product", "select user_id, date_trunc('day', ts)::timestamp as ts, round(product(1 + value / 1e4), 6) as result from events group by 1, 2")
def agg_daily_product(spark, sf):
    df = events(spark, sf, "value").withColumn("v", 1 + F.col("value") / 1e4)
    return aggregate(df, CTX, DAY, [Aggregate("Product", "v", "result")]).withColumn("result", F.round("result", 6))


@query("agg_first_last", "select user_id, date_trunc('day', ts)::timestamp as ts, arg_min(value, ts) as first_value, arg_max(value, ts) as last_value from events where value is not null group by 1, 2")
def agg_first_last(spark, sf):
    return aggregate(events(spark, sf, "value"), CTX, DAY, [Aggregate("First", "value", "first_value"), Aggregate("Last", "value", "last_value")])


def _grain(name: str, freq: str, sql: str):
    query(name, f"select {sql} as ts, count(*) as n, round(sum(value), 4) as total from events group by 1")(
        lambda spark, sf: aggregate(events(spark, sf, "value"), CTX, Granularity("g", freq, by_entity=False), [Aggregate("Count", "value", "n"), Aggregate("Sum", "value", "total")]).withColumn("total", F.round("total", 4))
    )


_grain("agg_week_sunday", "W", "(date_trunc('week', ts + interval 1 day) - interval 1 day)::timestamp")
_grain("agg_month", "MS", "date_trunc('month', ts)::timestamp")
_grain("agg_year", "YS", "date_trunc('year', ts)::timestamp")
_grain("agg_hour", "h", "date_trunc('hour', ts)::timestamp")
_grain("agg_15min", "15min", "time_bucket(interval 15 minutes, ts, timestamp '1970-01-01')")
_grain("agg_6hour", "6h", "time_bucket(interval 6 hours, ts, timestamp '1970-01-01')")


@query("agg_offset_day", "select (date_trunc('day', ts + interval 3 hours) - interval 3 hours)::timestamp as ts, count(*) as n from events group by 1")
def agg_offset_day(spark, sf):
    return aggregate(events(spark, sf, "value"), CTX, Granularity("d", "D", by_entity=False), [Aggregate("Count", "value", "n")], offset=timedelta(hours=3))


@query("agg_scope", "select user_id, date_trunc('day', ts)::timestamp as ts, round(sum(value) filter (where event_type in ('view', 'click')), 6) as result from events group by 1, 2")
def agg_scope(spark, sf):
    item = Aggregate("Sum", "value", "result", scope={"event_type": ["view", "click"]})
    return aggregate(events(spark, sf, "value", "event_type"), CTX, DAY, [item]).withColumn("result", F.round("result", 6))


@query("agg_scope_null", "select date_trunc('day', ts)::timestamp as ts, count(value) filter (where t is null or t = 'view') as n from (select *, nullif(event_type, 'error') as t from events) group by 1")
def agg_scope_null(spark, sf):
    df = events(spark, sf, "value", "event_type").withColumn("t", F.nullif("event_type", F.lit("error")))
    return aggregate(df, CTX, Granularity("d", "D", by_entity=False), [Aggregate("Count", "value", "n", {"min_count": 0}, {"t": [None, "view"]})])


@query("agg_dimensions", "select event_type, date_trunc('month', ts)::timestamp as ts, count(value) as n, round(avg(value), 6) as mean_value from events group by 1, 2")
def agg_dimensions(spark, sf):
    grain = Granularity("m", "MS", ("event_type",), by_entity=False)
    return aggregate(events(spark, sf, "value", "event_type"), CTX, grain, [Aggregate("Count", "value", "n"), Aggregate("Mean", "value", "mean_value")]).withColumn("mean_value", F.round("mean_value", 6))


@query("agg_items", "select l_suppkey, date_trunc('month', l_shipdate)::timestamp as l_shipdate, max(l_quantity) as l_quantity_max, max(l_discount) as l_discount_max from lineitem group by 1, 2")
def agg_items(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount")
    return aggregate_items(df, Context("l_suppkey", "l_shipdate"), Granularity("m", "MS"), ["l_quantity", "l_discount"], "max")


@query("agg_fill_periods", "with s as (select date_trunc('hour', ts) as h, count(*) as n from events where event_type = 'signup' group by 1) select g::timestamp as ts, s.n from (select unnest(generate_series((select min(h) from s)::timestamp, (select max(h) from s)::timestamp, interval 1 hour)) as g) left join s on s.h = g")
def agg_fill_periods(spark, sf):
    df = events(spark, sf, "value", "event_type").where("event_type = 'signup'")
    return aggregate(df, CTX, Granularity("h", "h", by_entity=False), [Aggregate("Count", "value", "n")], fill_periods=True)


@query("resample_daily", "select date_trunc('day', ts)::timestamp as ts, event_type, round(sum(value), 4) as value, arg_max(event_id, ts) as event_id from events group by 1, 2")
def resample_daily(spark, sf):
    df = events(spark, sf, "value", "event_type", "event_id").drop("user_id")
    return resample(df, CTX, "D", ["event_type"], {"value": "sum"}).withColumn("value", F.round("value", 4))


@query("agg_histogram")
def agg_histogram(spark, sf):
    return histogram(events(spark, sf, "value"), CTX, Granularity("u"), "value", "histogram", 10)


# the query layer


@query("scan_window", "select user_id, ts as at, value as v from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and event_type = 'view' and user_id in (1, 2, 3, 5, 8)")
def scan_window(spark, sf):
    return T.scan(table(spark, sf, "events"), ["user_id", "ts", "value"], ["user_id", "at", "v"], "ts", datetime(2024, 1, 5), datetime(2024, 1, 20), [1, 2, 3, 5, 8], filters={"event_type": "view"}, deviceid_col="user_id")


@query("readagg_dim_filter", """select c_mktsegment, date_trunc('month', o_orderdate)::timestamp as o_orderdate, round(sum(o_totalprice), 2) as total, count(o_orderkey) as orders, max(o_totalprice) as largest
    from orders left join customer on o_custkey = c_custkey where o_orderstatus in ('F', 'O') and o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1998-01-01' group by 1, 2""")
def readagg_dim_filter(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "deviceid")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("deviceid"), "c_mktsegment")
    out = read_agg(
        orders, {"o_totalprice": ["sum", "max"], "o_orderkey": ["count"]}, {"o_totalprice": ["total", "largest"], "o_orderkey": ["orders"]}, ["c_mktsegment"], "o_orderdate", "MS",
        customer, datetime(1995, 1, 1), datetime(1998, 1, 1), filters={"o_orderstatus": ["F", "O"]},
    )
    return out.withColumn("total", F.round("total", 2))


@query("readagg_first_last", "select event_type, date_trunc('hour', ts)::timestamp as ts, arg_min(value, ts) as first_value, arg_max(value, ts) as last_value from events group by 1, 2 having count(*) > 0")
def readagg_first_last(spark, sf):
    return read_agg(table(spark, sf, "events"), {"value": ["first", "last"]}, {"value": ["first_value", "last_value"]}, ["event_type"], "ts", "h")


@query("readagg_time_agg", "with d as (select event_type, ts, sum(value) as v from events group by 1, 2) select event_type, date_trunc('day', ts)::timestamp as ts, arg_max(v, ts) as last_sum from d group by 1, 2")
def readagg_time_agg(spark, sf):
    return query_time_agg(table(spark, sf, "events"), "value", "sum", "last", ["event_type"], "ts", "D", "last_sum")


@query("readagg_column", "select round(stddev_samp(value), 6) as value_std from events where ts >= timestamp '2024-01-10'")
def readagg_column(spark, sf):
    return query_column_aggregate(table(spark, sf, "events"), "value", "std", "ts", start_ts=datetime(2024, 1, 10)).withColumn("value_std", F.round("value_std", 6))


# expressions and filters


def _step(name: str, sql: str | None, steps: Callable[[], list[Step]] | list, columns: str, source: str = "events", prepare=None, ctx: Context = CTX):
    """A query that applies steps to events and keeps event_id and the named columns."""

    def run(spark, sf):
        df = table(spark, sf, source)
        df = prepare(df) if prepare else df
        for kind, parameters in steps:
            df = Step(kind, **parameters).apply(df, ctx)
        return df.select(*columns.split())

    query(name, sql)(run)


_step("expr_arith", "select event_id, round(value * 2 + abs(value - 100) / 3, 6) as y, value > 100 and event_type = 'view' as big_view from events",
      [("PythonExpression", {"expression": "round(${value} * 2 + abs(df['value'] - 100) / 3, 6)", "output_name": "y"}), ("NewColFromCalculation", {"expression": "(${value} > 100) & (${event_type} == 'view')", "name": "big_view"})], "event_id y big_view")
_step("expr_ifthenelse", "select event_id, case when v > 250 then v - 250 else 0.0 end as y from (select *, case when event_type <> 'error' then value end as v from events)",
      [("IfThenElse", {"conditional_expression": "${v} > 250", "true_expression": "${v} - 250", "false_expression": "0.0", "output_item": "y"})], "event_id y", prepare=lambda d: d.withColumn("v", F.when(F.col("event_type") != "error", F.col("value"))))
_step("expr_conditional", "select event_id, case when event_type = 'purchase' then value end as bought from events", [("ConditionalItems", {"conditional_expression": "${event_type} == 'purchase'", "conditional_items": ["value"], "output_items": ["bought"]})], "event_id bought")
_step("expr_coalesce", "select event_id, coalesce(case when event_type = 'view' then value end, -1.0) as y from events", [("Coalesce", {"data_items": ["v", "w"], "output_item": "y"})], "event_id y", prepare=lambda d: d.withColumns({"v": F.when(F.col("event_type") == "view", F.col("value")), "w": F.lit(-1.0)}))
_step("expr_coalesce_dimension", "select event_id, coalesce(nullif(event_type, 'error'), props) as y from events", [("CoalesceDimension", {"data_items": ["t", "props"], "output_item": "y"})], "event_id y", prepare=lambda d: d.withColumn("t", F.nullif("event_type", F.lit("error"))))
_step("expr_multiply", "select event_id, value * user_id as a, value * 1 as b, value * 2.5 as c from events",
      [("MultiplyTwoItems", {"input_item_1": "value", "input_item_2": "user_id", "output_item": "a"}), ("MultiplyColumns", {"input_items": ["value", "nothing"], "output_item": "b"}), ("MultiplyByFactor", {"input_items": ["value"], "factor": 2.5, "output_items": ["c"]})], "event_id a b c", prepare=lambda d: d.withColumn("nothing", F.lit(None).cast("double")))
_step("filter_mask", "select event_id, case when event_type in ('view', 'click') then value end as seen from events", [("Filter", {"names": ["seen"], "filtered_sources": ["value"], "expression": "${event_type}.isin('view', 'click')"})], "event_id seen")
_step("filter_rows", "select event_id, true as keep from events where event_type = 'view' and user_id in (1, 2, 3)", [("StatusFilter", {"status_input_item": "event_type", "include_only": "view", "output_item": "keep"}), ("EntityFilter", {"entity_list": [1, 2, 3]})], "event_id keep")
_step("filter_company", "select c_custkey, true as flag from customer where c_mktsegment = 'BUILDING'", [("CompanyFilter", {"company_code": "c_mktsegment", "company": "BUILDING", "status_flag": "flag"})], "c_custkey flag", "customer", ctx=Context("c_custkey", "none"))
_step("filter_expression", "select event_id from events where value > 50 and value <= 60", [("BaseFilter", {"expression": "${value} > 50 and ${value} <= 60"})], "event_id")
_step("outlier_remover", "select event_id, case when value between 20 and 80 then value end as y from events", [("OutlierRemover", {"name": "y", "source": "value", "min": 20, "max": 80})], "event_id y")
_step("negative_remover", "select event_id, case when value - 50 >= 0 then value - 50 end as y from events", [("NegativeRemover", {"names": "y", "sources": "v"})], "event_id y", prepare=lambda d: d.withColumn("v", F.col("value") - 50))
_step("flow_rate", "select event_id, (value - user_id) / value > 0.5 as loss from events", [("FlowRateMonitor", {"input_flows": ["value"], "output_flows": ["user_id"], "loss_threshold": 0.5, "output": "loss"})], "event_id loss")
_step("pivot_masked", "select event_id, case when event_type = 'view' then value end as a, case when event_type = 'click' then value end as b from events", [("PivotRowsToColumns", {"pivot_by_item": "event_type", "pivot_values": ["view", "click"], "input_item": "value", "null_value": None, "output_items": ["a", "b"]})], "event_id a b")
_step("copy_types", "select event_id, value as n, ts as d, event_type as s from events", [("InputsAndOutputsOfMultipleTypes", {"input_number": "value", "input_date": "ts", "input_str": "event_type", "output_number": "n", "output_date": "d", "output_str": "s"})], "event_id n d s")
_step("drop_null", "select event_id from (select event_id, case when event_type = 'view' then value end as a, case when value > 100 then 1 end as b from events) where not (a is null and b is null)", [("DropNull", {"exclude_cols": ["event_id"]})], "event_id",
      prepare=lambda d: d.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "view", F.col("value")).alias("a"), F.when(F.col("value") > 100, 1).alias("b")))
_step("scoped_transform", "select event_id, case when event_type = 'view' then value + 1 end as y from events", [("PythonExpression", {"expression": "${value} + 1", "output_name": "y", "scope": {"event_type": ["view"]}})], "event_id y")
_step("date_diff", "select event_id, round(epoch_us(ts + interval 42 days) / 8.64e10 - epoch_us(ts) / 8.64e10, 6) as y from events", [("DateDifference", {"date_2": "later", "num_days": "d"}), ("PythonExpression", {"expression": "round(${d}, 6)", "output_name": "y"})], "event_id y", prepare=lambda d: d.withColumn("later", F.col("ts") + F.expr("interval 42 days")))
_step("date_diff_const", "select event_id, round((epoch_us(timestamp '2024-02-01') - epoch_us(ts)) / 8.64e10, 6) as y from events", [("DateDifferenceConstant", {"date_1": "ts", "date_constant": datetime(2024, 2, 1), "num_days": "d"}), ("PythonExpression", {"expression": "round(${d}, 6)", "output_name": "y"})], "event_id y")
_step("date_diff_reference", "select event_id, round((1706745600000000 - epoch_us(ts)) / 8.64e10, 6) as y from events", [("DateDifferenceReference", {"date_1": "ts", "ref_date": 1706745600, "num_days": "d"}), ("PythonExpression", {"expression": "round(${d}, 6)", "output_name": "y"})], "event_id y")
_step("timestamp_col", "select event_id, ts as at from events", [("TimestampCol", {"output_item": "at"})], "event_id at")
_step("string_array", "select event_id, round(0.5 + 0.25 * value - 0.1 * user_id + 0.05 * 7, 6) as y from events", [("ComputationsOnStringArray", {"input_str": "s", "output_item": "d"}), ("PythonExpression", {"expression": "round(${d}, 6)", "output_name": "y"})], "event_id y", prepare=lambda d: d.withColumn("s", F.concat_ws(",", F.col("value"), F.col("user_id"), F.lit(7))))
_step("occupancy_rate", "select event_id, round(value / 7 * 100, 2) as rate from events", [("MsiOccupancyRate", {"occupancy_count": "value", "capacity": "seats", "occupancy_rate": "rate"})], "event_id rate", prepare=lambda d: d.withColumn("seats", F.lit(7)))
_step("occupancy_by_unit", "select event_id, case when value > 10 then value / ((value > 10)::int + (value > 50)::int) end as a, case when value > 50 then value / ((value > 10)::int + (value > 50)::int) end as b from events", [("MsiOccupancyCountByUnit", {"occupancy_count": "value", "weights": ["u", "w"], "weighted_occupancy_counts": ["a", "b"]})], "event_id a b", prepare=lambda d: d.withColumns({"u": F.col("value") > 10, "w": F.col("value") > 50}))
_step("frequency_rate", "select event_id, round(value / 540.0 * 100, 6) as rate from events", [("MsiFrequencyRate", {"occupancy_per_day": "value", "office_hour_start": "a", "office_hour_end": "b", "frequency_rate": "r"}), ("PythonExpression", {"expression": "round(${r}, 6)", "output_name": "rate"})], "event_id rate", prepare=lambda d: d.withColumns({"a": F.lit("08:30"), "b": F.lit("17:30")}))

# alerts

_step("alert_expression", "select event_id, case when value > 100 and event_type = 'view' then true end as alert from events", [("AlertExpression", {"expression": "${value} > 100 and ${event_type} == 'view'", "alert_name": "alert"})], "event_id alert")
_step("alert_high", "select event_id, case when value >= 100 then true end as alert from events", [("AlertHighValue", {"input_item": "value", "upper_threshold": 100, "alert_name": "alert"})], "event_id alert")
_step("alert_low", "select event_id, case when value <= 10 then true end as alert from events", [("AlertLowValue", {"input_item": "value", "lower_threshold": 10, "alert_name": "alert"})], "event_id alert")
_step("alert_out_of_range", "select event_id, case when value >= 100 then true end as hi, case when value <= 10 then true end as lo from events", [("AlertOutOfRange", {"input_item": "value", "lower_threshold": 10, "upper_threshold": 100, "output_alert_upper": "hi", "output_alert_lower": "lo"})], "event_id hi lo")
_step("alert_with_filter", "select event_id, (value > 50 and event_type = 'click')::int as alert from events", [("AlertExpressionWithFilter", {"expression": "${value} > 50", "dimension_name": "event_type", "dimension_value": "click", "alert_name": "alert"})], "event_id alert")


@query("alert_pulse", """with f as (select *, value > 20 and event_type = 'view' as hit from events), g as (select *, sum(case when hit then 0 else 1 end) over (partition by user_id order by ts) as run from f),
    r as (select *, count(*) over (partition by user_id, run, hit) as n, row_number() over (partition by user_id, run, hit order by ts) as i, max(ts) over (partition by user_id, run, hit) as e from g)
    select event_id, case when hit and i = 1 and n >= 2 then n else 0 end::bigint as alert, case when hit and i = 1 and n >= 2 then e end as alert_end from r""")
def alert_pulse(spark, sf):
    step = Step("AlertExpressionWithFilterExt", expression="${value} > 20", dimension_name="event_type", dimension_value="view", alert_name="alert", alert_end="alert_end", pulse_trigger=True)
    return step.apply(events(spark, sf), CTX).select("event_id", "alert", "alert_end")


@query("alert_no_data", """with g as (select user_id, ts, lead(ts) over (partition by user_id order by ts) as nxt from (select distinct user_id, ts from events))
    select user_id, a as ts, true as no_data_alert from (select user_id, nxt, unnest(generate_series(ts + interval 1 day, nxt, interval 12 hours)) as a from g where ts + interval 1 day < nxt) where a < nxt""")
def alert_no_data(spark, sf):
    return L.no_data_alerts(events(spark, sf, "value"), CTX, 86_400, 43_200)


@query("alert_occurrences", """with recursive o as (select user_id, ts, row_number() over w as i, lag(ts, 2) over w as back from events where value > 20 window w as (partition by user_id order by ts)),
    able as (select user_id, ts, i from o where back > ts - interval 2 days),
    fired as (
        select user_id, min(ts) as ts, min(i) as i from able group by user_id
        union all
        select a.user_id, min(a.ts), min(a.i) from fired f join able a on a.user_id = f.user_id and a.i >= f.i + 3 and a.ts > f.ts + interval 6 hours group by a.user_id
    )
    select e.event_id, true as alert from events e join (select distinct user_id, ts from fired) f on f.user_id = e.user_id and f.ts = e.ts""")
def alert_occurrences(spark, sf):
    step = Step("AlertByOccurrencesCount", expression="${value} > 20", min_occurrences=3, time_window=2, window_time_unit="DAYS", occurrence_mode="EVERY", alert_name="alert", cooldown=6, cooldown_time_unit="HOURS")
    return step.apply(events(spark, sf), CTX).where("alert").select("event_id", "alert")


@query("alert_table", "select 'events' as entity_type_id, 'hi' as data_item_name, user_id as entity_id, ts as timestamp from events where value >= 100 union all select 'events', 'lo', user_id, ts from events where value <= 5")
def alert_table(spark, sf):
    df = Step("AlertOutOfRange", input_item="value", lower_threshold=5, upper_threshold=100, output_alert_upper="hi", output_alert_lower="lo").apply(events(spark, sf), CTX)
    return L.computed_alerts(df, CTX, ["hi", "lo"], "events")


@query("alert_diff", """with c as (select user_id, ts from events where value >= 100), s as (select user_id, ts, case when event_type = 'view' then 'Resolved' else 'New' end as st, case when event_type = 'click' then 'someone' end as who from events where value >= 90 and user_id % 2 = 0)
    select coalesce(c.user_id, s.user_id) as user_id, coalesce(c.ts, s.ts) as ts,
      case when s.ts is null then 'new' when who is null and c.ts is null and st <> 'Resolved' then 'stale' when who is null and c.ts is not null and st = 'Resolved' then 'reactivated' end as change,
      case when s.ts is not null and c.ts is null then 'Resolved' else 'New' end as domain_status
    from c full join s on c.user_id = s.user_id and c.ts = s.ts
    where s.ts is null or (who is null and ((c.ts is null and st <> 'Resolved') or (c.ts is not null and st = 'Resolved')))""")
def alert_diff(spark, sf):
    e = events(spark, sf)
    stored = e.where("value >= 90 and user_id % 2 = 0").select("user_id", "ts", F.when(F.col("event_type") == "view", "Resolved").otherwise("New").alias("domain_status"), F.when(F.col("event_type") == "click", "someone").alias("last_updated_by"))
    return L.alert_changes(e.where("value >= 100"), stored, ["user_id", "ts"])


# joins


@query("lookup_left", "select o_orderkey, c_name as customer, c_acctbal as balance from orders left join customer on o_custkey = c_custkey")
def lookup_left(spark, sf):
    ctx = Context("o_orderkey", "o_orderdate", tables={"customer": table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")})
    step = Step("DatabaseLookup", lookup_table_name="customer", lookup_keys=["o_custkey"], lookup_items=["c_name", "c_acctbal"], output_items=["customer", "balance"])
    return step.apply(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), ctx).select("o_orderkey", "customer", "balance")


def _changes(spark, sf):
    return events(spark, sf).where("event_type in ('purchase', 'error')").select("user_id", F.col("ts").alias("start_date"), F.concat(F.col("event_type"), F.col("event_id")).alias("state"))


@query("scd_asof", """with c as (select user_id, ts as s, event_type || event_id as state from events where event_type in ('purchase', 'error'))
    select event_id, c.state from events e asof left join c on e.user_id = c.user_id and e.ts >= c.s""")
def scd_asof(spark, sf):
    ctx = Context("user_id", "ts", tables={"changes": _changes(spark, sf)})
    return Step("SCDLookup", table_name="changes", output_item="state", property_name="state").apply(events(spark, sf, "event_id"), ctx).select("event_id", "state")


@query("scd_default", """with c as (select user_id, ts as s, ts + interval 8 hours as x, event_type || event_id as state from events where event_type in ('purchase', 'error'))
    select e.event_id, coalesce(arg_max(c.state, struct_pack(s := c.s, p := c.state)), 'none') as state from events e left join c on e.user_id = c.user_id and e.ts >= c.s and e.ts < c.x group by e.event_id""")
def scd_default(spark, sf):
    ctx = Context("user_id", "ts", tables={"changes": _changes(spark, sf).withColumn("end_date", F.col("start_date") + F.expr("interval 8 hours"))})
    return Step("SCDLookupWithDefault", table_name="changes", dimension_name="state", default_value="none", output_item="state").apply(events(spark, sf, "event_id"), ctx).select("event_id", "state")


_PARTS = ("select user_id, ts, value, null::varchar as t from events where event_type = 'view'", "select user_id, ts, value * 2 as value, event_type as t from events where value > 50")


def _two(spark, sf):
    e = events(spark, sf)
    return e.where("event_type = 'view'").select("user_id", "ts", "value"), e.where("value > 50").select("user_id", "ts", (F.col("value") * 2).alias("value"), F.col("event_type").alias("t"))


@query("merge_outer", f"with a as ({_PARTS[0]}), b as ({_PARTS[1]}) select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.ts, b.ts) as ts, coalesce(a.value, b.value) as value, b.t from a full join b on a.user_id = b.user_id and a.ts = b.ts")
def merge_outer(spark, sf):
    return J.merge_series(*_two(spark, sf), CTX, "outer")


@query("merge_concat", f"{_PARTS[0]} union all {_PARTS[1]}")
def merge_concat(spark, sf):
    return J.merge_series(*_two(spark, sf), CTX, "concat")


@query("merge_asof", f"with a as ({_PARTS[0]}), b as ({_PARTS[1]}) select a.user_id, a.ts, a.value, case when a.ts - b.ts <= interval 1 day then b.t end as t from a asof left join b on a.user_id = b.user_id and a.ts >= b.ts")
def merge_asof(spark, sf):
    a, b = _two(spark, sf)
    return J.merge_series(a, b.drop("value"), CTX, "nearest")


@query("asof_nearest", f"""with a as ({_PARTS[0]}), b as ({_PARTS[1]}), x as (select a.user_id, a.ts, b.t, b.ts as bt from a asof left join b on a.user_id = b.user_id and a.ts >= b.ts), y as (select a.user_id, a.ts, b.t, b.ts as bt from a asof left join b on a.user_id = b.user_id and a.ts <= b.ts)
    select x.user_id, x.ts, case when x.bt is null or (y.bt is not null and epoch_us(y.bt) - epoch_us(x.ts) < epoch_us(x.ts) - epoch_us(x.bt)) then y.t else x.t end as t from x join y on x.user_id = y.user_id and x.ts = y.ts""")
def asof_nearest(spark, sf):
    a, b = _two(spark, sf)
    return J.asof_join(a.drop("value"), b.withColumnRenamed("ts", "bt"), "user_id", "ts", "bt", ["t"], direction="nearest")


@query("semi_join_filters", "select o_orderkey from orders where o_orderstatus = 'F' and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_join_filters(spark, sf):
    right = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.subquery_join(table(spark, sf, "orders"), right, ["o_custkey"], filters={"o_orderstatus": ["F"]}).select("o_orderkey")


@query("data_merge_outer", "with n as (select user_id, ts, -value as value from events where event_type = 'view') select coalesce(n.user_id, e.user_id) as user_id, coalesce(n.ts, e.ts) as ts, coalesce(n.value, e.value) as value, 7 as k from (select user_id, ts, value from events where value > 20) e full join n on e.user_id = n.user_id and e.ts = n.ts")
def data_merge_outer(spark, sf):
    e = events(spark, sf)
    out = J.data_merge(e.where("value > 20").select("user_id", "ts", "value"), e.where("event_type = 'view'").select("user_id", "ts", (-F.col("value")).alias("value")), ["user_id", "ts"])
    return J.data_merge(out, 7, ["user_id", "ts"], "k")


@query("compare_frames", "select event_id, 'left' as side from events where event_type = 'view' and value <= 50 union all select event_id, 'right' from events where event_type <> 'view' and value > 50")
def compare_frames(spark, sf):
    e = events(spark, sf)
    return J.compare_frames(e.where("event_type = 'view'").select("event_id"), e.where("value > 50").select("event_id"))


@query("unmatched_members", "select distinct user_id from events where user_id not in (select c_custkey from customer where c_custkey % 3 = 0)")
def unmatched_members(spark, sf):
    dim = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return EntityType("events", events(spark, sf), "user_id", "ts", dimension=dim).unmatched_members()


@query("activity_prefer_earliest", """with a as (select user_id, event_id, event_type as activity, ts as s, ts + to_microseconds(floor(value * 60000000 * 20)::bigint) as e from events),
    b as (select *, max(e) over (partition by user_id order by s, e desc, activity rows between unbounded preceding and 1 preceding) as p from a)
    select event_id, activity, greatest(s, p) as start_date, e as end_date, round(round((epoch_us(e) - epoch_us(greatest(s, p))) / 1e6) / 60, 6) as duration from b where p is null or e > p""")
def activity_prefer_earliest(spark, sf):
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("value") * 60_000_000 * 20).cast("long") / F.lit(1e6))
    rows = events(spark, sf).select("user_id", "event_id", F.col("event_type").alias("activity"), F.col("ts").alias("start_date"), (F.col("ts") + length).alias("end_date"))
    return A.durations(A.resolve_overlaps(rows, ["user_id"])).select("event_id", "activity", "start_date", "end_date", F.round("duration", 6).alias("duration"))


# windows

_step("ffill_entity", "select event_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by ts rows unbounded preceding) as y from events", [("FillForwardByEntity", {"input_item": "v", "output_item": "y"})], "event_id y", prepare=lambda d: d.withColumn("v", F.when(F.col("event_type") == "view", F.col("value"))))
_step("derivative", "select event_id, round(coalesce(value - lag(value) over (partition by user_id order by ts), 0), 6) as y from events", [("Derivative", {"input_item": "value", "output_item": "d"}), ("PythonExpression", {"expression": "round(${d}, 6)", "output_name": "y"})], "event_id y")
_step("rolling_mean", "select event_id, round(avg(value) over (partition by user_id order by ts rows between 3 preceding and 1 preceding), 6) as y from events", [("FeatureBuilder", {"features": ["value"], "lag": 3, "method": "mean", "lagged_features": ["d"]}), ("PythonExpression", {"expression": "round(${d}, 6)", "output_name": "y"})], "event_id y")
_step("rolling_std", "select event_id, round(stddev_samp(value) over (partition by user_id order by ts rows between 5 preceding and 1 preceding), 6) as y from events", [("FeatureBuilder", {"features": ["value"], "lag": 5, "method": "std", "lagged_features": ["d"]}), ("PythonExpression", {"expression": "round(${d}, 6)", "output_name": "y"})], "event_id y")
_step("lag_feature", "select event_id, lag(value) over (partition by user_id order by ts) as y from events", [("FeatureBuilder", {"features": ["value"], "lag": 1, "method": "shift", "lagged_features": ["y"]})], "event_id y")
_step("first_last_in_day", "select event_id, round((epoch_us(min(ts) over w) - epoch_us(date_trunc('day', ts)::timestamp)) / 6e7, 4) as a, round(1440 - (epoch_us(max(ts) over w) - epoch_us(date_trunc('day', ts)::timestamp)) / 6e7, 4) as b from events window w as (partition by user_id, date_trunc('day', ts))",
      [("TimeToFirstAndLastInDay", {"input_item": "value", "time_to_first": "x", "time_from_last": "z"}), ("PythonExpression", {"expression": "round(${x}, 4)", "output_name": "a"}), ("PythonExpression", {"expression": "round(${z}, 4)", "output_name": "b"})], "event_id a b")
_step("state_time_prep", "with s as (select *, (value > 50)::int as v from events) select event_id, coalesce(v - lag(v) over (partition by user_id order by ts), 2) || ',' || v || ',' || (epoch_us(ts) // 1000000) || ',' || user_id as s from s", [("StateTimePreparation", {"source": "value", "state_name": 50, "condition": ">", "name": "s"})], "event_id s")


@query("time_in_state", """with x as (select user_id, date_trunc('day', ts)::timestamp as d, value > 50 as o, coalesce(epoch_us(lead(ts) over w) - epoch_us(ts), epoch_us(ts) - epoch_us(lag(ts) over w), 0) / 1e6 as s from events window w as (partition by user_id, date_trunc('day', ts) order by ts))
    select user_id, d as ts, round(sum(case when o then s else 0 end), 4) as seconds from x group by 1, 2""")
def time_in_state_query(spark, sf):
    df = events(spark, sf, "value").withColumn("on", F.col("value") > 50)
    return time_in_state(df, CTX, DAY, "on", "seconds").withColumn("seconds", F.round("seconds", 4))


@query("time_in_state_encoded", """with x as (select user_id, value > 50 as o, epoch_us(ts) // 1000000 as t from events), y as (select user_id, o, coalesce(lead(t) over w - t, t - lag(t) over w, 0) as s from x window w as (partition by user_id order by t))
    select user_id, sum(case when o then s else 0 end)::double as seconds from y group by 1""")
def time_in_state_encoded(spark, sf):
    df = Step("StateTimePreparation", source="value", state_name=50, condition=">", name="s").apply(events(spark, sf, "value"), CTX)
    return W.decoded_time_in_state(df, CTX, "s", "seconds", ["user_id"])


@query("interpolate_gaps")
def interpolate_gaps(spark, sf):
    df = events(spark, sf).withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return W.interpolate(df, CTX, "v", "y").select("event_id", F.round("y", 6).alias("y"))


@query("least_gap", "with g as (select user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 1e6 as s from events) select user_id, greatest(min(s), 5.0) as min_gap_s from g group by 1")
def least_gap(spark, sf):
    return W.least_gap(events(spark, sf, "value"), CTX)


@query("change_end_dates", "select user_id, event_id, ts as start_date, coalesce(lead(ts) over (partition by user_id order by ts) - interval 1 microsecond, timestamp '2262-04-11') as end_date from events")
def change_end_dates(spark, sf):
    return W.with_end_dates(events(spark, sf, "event_id").withColumnRenamed("ts", "start_date"), "user_id")


@query("moving_average", "select event_id, round(avg(value) over (partition by user_id order by ts rows between 2 preceding and current row), 6) as y from events")
def moving_average(spark, sf):
    return W.moving_average(events(spark, sf), CTX, "value", "y").select("event_id", F.round("y", 6).alias("y"))


# occupancy


@query("occupancy_count_grid", """with s as (select user_id, date_trunc('day', ts)::timestamp as d, max(greatest(value - 20, 0)) as m, arg_max(greatest(value - 20, 0), ts) as l from events group by 1, 2),
    g as (select user_id, unnest(generate_series(min(d), max(d), interval 1 day)) as d from s group by 1)
    select g.user_id, g.d as ts, coalesce(s.m, last_value(s.l ignore nulls) over (partition by g.user_id order by g.d rows between unbounded preceding and 1 preceding), 0) as occupied from g left join s on s.user_id = g.user_id and s.d = g.d""")
def occupancy_count_grid(spark, sf):
    return occupancy_count(events(spark, sf, "value").withColumn("value", F.col("value") - 20), CTX, "D", "value", "occupied")


@query("occupancy_duration", """with x as (select user_id, date_trunc('day', ts)::timestamp as d, value - 30 as n, coalesce((epoch_us(lead(ts) over (partition by user_id, date_trunc('day', ts) order by ts)) - epoch_us(ts)) / 1e6 / 60, 1.0) as t from events)
    select user_id, d as ts, round(sum(case when n > 0 then t else 0 end), 6) as minutes from x group by 1, 2""")
def occupancy_duration_query(spark, sf):
    df = events(spark, sf, "value").withColumn("n", F.col("value") - 30)
    return occupancy_duration(df, CTX, DAY, "n", "minutes", timedelta(minutes=1)).withColumn("minutes", F.round("minutes", 6))


@query("occupancy_location")
def occupancy_location_query(spark, sf):
    df = events(spark, sf, "event_type").withColumn("y", F.col("user_id") % 3)
    return occupancy_location(df, CTX, DAY, "event_type", "y", "places")


# shifts


@query("shift_identify", """with x as (select event_id, ts, date_trunc('day', ts)::timestamp as d, epoch_us(ts) - epoch_us(date_trunc('day', ts)::timestamp) as m from events)
    select event_id, case when m < 19800000000 then d - interval 1 day else d end as shift_day,
      case when m < 19800000000 or m >= 75600000000 then '3' when m < 50400000000 then '1' else '2' end as shift_id,
      case when m < 19800000000 then d - interval 3 hours when m < 50400000000 then d + interval 330 minutes when m < 75600000000 then d + interval 14 hours else d + interval 21 hours end as shift_start
    from x""")
def shift_identify(spark, sf):
    return Step("IdentifyShiftFromTimestamp", shifts=SHIFTS).apply(events(spark, sf, "event_id"), CTX).select("event_id", "shift_day", "shift_id", "shift_start")


@query("shift_calendar", """with c as (select d::timestamp as shift_day, shift_id, d::timestamp + to_minutes(a) as shift_start
      from (select unnest(generate_series(min(ts)::date - 2, max(ts)::date + 1, interval 1 day)) as d from events), (values ('1', 330), ('2', 840), ('3', 1260)) v(shift_id, a))
    select event_id, shift_day, shift_id, shift_start from events e asof left join c on e.ts >= c.shift_start""")
def shift_calendar(spark, sf):
    out = Step("ShiftCalendar", shift_definition=SHIFTS, period_start_date="shift_start", period_end_date="shift_end").apply(events(spark, sf, "event_id"), CTX)
    return out.select("event_id", "shift_day", "shift_id", "shift_start")


@query("shift_split", """with x as (select event_id, ts as s, ts + to_microseconds(floor(value * 600000000)::bigint) as e from events), k as (select * from (values ('1', 330, 840), ('2', 840, 1260), ('3', 1260, 1770)) v(shift_id, a, b)),
    c as (select d::timestamp as d, shift_id, d + to_minutes(a) as a, d + to_minutes(b) as b from (select unnest(generate_series(timestamp '2023-12-01', timestamp '2024-04-01', interval 1 day)) as d), k)
    select event_id, c.d as shift_day, shift_id, greatest(s, a) as shift_start, least(e, b) as shift_end from x join c on s < b and e > a""")
def shift_split(spark, sf):
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("value") * 600_000_000).cast("long") / F.lit(1e6))
    rows = events(spark, sf, "event_id", "value").withColumn("e", F.col("ts") + length)
    return S.split_by_shifts(rows, "ts", "e", S.shift_plan(SHIFTS)).select("event_id", "shift_day", "shift_id", "shift_start", "shift_end")


# sinks


@query("unpivot_metrics", "select 'value' as key, user_id, ts, value as value_n, null::varchar as value_s from events union all select 'event_type', user_id, ts, null, event_type from events where event_type <> 'error'")
def unpivot_metrics(spark, sf):
    df = events(spark, sf).withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return T.to_long(df, ["user_id", "ts"], ["value", "event_type"]).select("key", "user_id", "ts", "value_n", "value_s")


@query("pivot_metrics", "select user_id, ts, value, nullif(event_type, 'error') as event_type from events")
def pivot_metrics(spark, sf):
    df = events(spark, sf).withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return T.from_long(T.to_long(df, ["user_id", "ts"], ["value", "event_type"]), ["user_id", "ts"], {"value": "value_n", "event_type": "value_s"})


@query("upsert_changed", "select user_id, ts, case when event_type = 'view' then value + 1 else value end as value from events where (event_type = 'view' and value > 30) or (value > 30 and user_id % 2 = 1)")
def upsert_changed(spark, sf):
    e = events(spark, sf)
    stored = e.where("user_id % 2 = 0").select("user_id", "ts", "value")
    new = e.where("value > 30").select("user_id", "ts", F.when(F.col("event_type") == "view", F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return T.upsert(stored, new, ["user_id", "ts"])[1]


@query("scalar_sql", "select event_id, (select max(c_acctbal) from customer) as top from events")
def scalar_sql(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("tidewell_customer")
    return Step("NewColFromScalarSql", sql="select max(c_acctbal) from tidewell_customer", name="top").apply(events(spark, sf, "event_id"), CTX).select("event_id", "top")


# scores and scalers


@query("robust_threshold", """with q as (select user_id, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, median(value) as m from events group by 1), d as (select e.user_id, median(abs(value - m)) * 1.4826 as mad from events e join q using (user_id) group by 1)
    select event_id, value < 2.5 * a - 1.5 * b or value > 2.5 * b - 1.5 * a as outlier, abs(value - m) > 2 * mad as anomaly from events join q using (user_id) join d using (user_id)""")
def robust_threshold(spark, sf):
    return Step("RobustThreshold", input_item="value", threshold=3, outlier="outlier", anomaly="anomaly").apply(events(spark, sf), CTX).select("event_id", "outlier", "anomaly")


def _scaler(name: str, kind: str, sql: str):
    def run(spark, sf):
        return Step(kind, features=["value"], predictions=["y"]).apply(events(spark, sf), CTX).select("event_id", F.round("y", 6).alias("y"))

    query(name, sql)(run)


_scaler("minmax_scale", "MinMax_Scaler", "select event_id, round(coalesce((value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0), 0), 6) as y from events window w as (partition by user_id)")
_scaler("standard_scale", "Standard_Scaler", "select event_id, round(coalesce((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 0), 6) as y from events window w as (partition by user_id)")
_scaler("robust_scale", "Robust_Scaler", "with q as (select user_id, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.5) as m, quantile_cont(value, 0.75) as b from events group by 1) select event_id, round(coalesce((value - m) / nullif(b - a, 0), 0), 6) as y from events join q using (user_id)")


@query("zscore_base", "select event_id, round(coalesce(abs(value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 0), 6) as y from events window w as (partition by user_id)")
def zscore_base(spark, sf):
    return Step("AnomalyScorer", input_item="value", output_items=["y"]).apply(events(spark, sf), CTX).select("event_id", F.round("y", 6).alias("y"))


@query("no_data_zscore", """with t as (select event_id, user_id, epoch_us(ts) / 1e6 as t, epoch_us(lag(ts) over w) / 1e6 as b, epoch_us(lead(ts) over w) / 1e6 as a from events window w as (partition by user_id order by ts)), g as (select *, coalesce((a - b) / 2, a - t, t - b, 0) as g from t)
    select event_id, round(coalesce(abs(g - avg(g) over v) / nullif(stddev_pop(g) over v, 0), 0), 4) as y from g window v as (partition by user_id)""")
def no_data_zscore(spark, sf):
    return Step("NoDataAnomalyScoreExt", input_item="value", output_item="y").apply(events(spark, sf), CTX).select("event_id", F.round("y", 4).alias("y"))


@query("binned_ensemble", "with l as (select event_id, case when value >= 200 then 4 when value >= 150 then 3 when value >= 100 then 2 when value >= 75 then 1 else 0 end as a, case when value / 10 >= 20 then 4 when value / 10 >= 15 then 3 when value / 10 >= 10 then 2 when value / 10 >= 7.5 then 1 else 0 end as b from events) select event_id, (a + b) / 2.0::double as y from l")
def binned_ensemble(spark, sf):
    df = events(spark, sf).withColumn("tenth", F.col("value") / 10)
    return Step("EnsembleAnomalyScore", scores=["value", "tenth"], thresholds=[100, 10], output_item="y").apply(df, CTX).select("event_id", "y")


def _score(name: str, kind: str, **parameters):
    query(name)(lambda spark, sf: Step(kind, input_item="value", output_item="score", windowsize=12, **parameters).apply(events(spark, sf, "event_id", "value"), CTX).select("event_id", "score"))


for _name, _kind in {
    "spectral_score": "SpectralAnomalyScore", "kmeans_score": "KMeansAnomalyScore", "kmeans_score_v2": "KMeansAnomalyScoreV2", "gam_score": "GeneralizedAnomalyScore", "gam_score_v2": "GeneralizedAnomalyScoreV2", "fft_score": "FFTbasedGeneralizedAnomalyScore",
    "fft_score_v2": "FFTbasedGeneralizedAnomalyScoreV2", "saliency_score": "SaliencybasedGeneralizedAnomalyScore", "saliency_score_v2": "SaliencybasedGeneralizedAnomalyScoreV2", "no_data_score": "NoDataAnomalyScore", "matrix_profile": "MatrixProfileAnomalyScore", "change_point": "ChangePointDetector",
}.items():
    _score(_name, _kind)


@query("kde_threshold", """with s as (select user_id, count(value) as n, min(value) as low, coalesce(stddev_samp(value), 0) * pow(count(value), -0.2) as h from events group by 1),
    u as (select e.user_id, (value - low) / h * 8 as u from events e join s on s.user_id = e.user_id where h > 0),
    w as (select user_id, c, sum(w) as w from (select user_id, floor(u)::bigint as c, 1 + floor(u) - u as w from u union all select user_id, floor(u)::bigint + 1, u - floor(u) from u) group by 1, 2),
    d as (select user_id, c + k as c, sum(w * exp(-0.5 * k * k / 64.0)) as d from w, (select unnest(range(-40, 41)) as k) group by 1, 2),
    r as (select user_id, min(c) as a, max(c) as b from (select *, max(d) over (partition by user_id) as top from d) where d >= 0.05 * top group by 1)
    select event_id, value between low + coalesce(a, 0) * h / 8 and low + coalesce(b, 0) * h / 8 as inside from events e join s on s.user_id = e.user_id left join r on r.user_id = e.user_id""")
def kde_threshold(spark, sf):
    return Step("RobustThresholdKDE", input_item="value", threshold=0.05, output_item="inside").apply(events(spark, sf, "event_id", "value"), CTX).select("event_id", "inside")


def _with_hour(spark, sf):
    return events(spark, sf, "event_id", "value").withColumn("hour", F.hour("ts").cast("double")).withColumn("y", F.col("value") * 0.5 + F.col("hour"))


@query("bayes_ridge")
def bayes_ridge(spark, sf):
    return Step("BayesRidgeRegressor", features=["value", "hour"], targets=["y"], predictions=["p"], deviations=["s"]).apply(_with_hour(spark, sf), CTX).select("event_id", F.round("p", 3).alias("p"), "s")


@query("kde_score")
def kde_score(spark, sf):
    return Step("KDEAnomalyScore", features=["value"], targets=["y"], predictions=["density"]).apply(_with_hour(spark, sf), CTX).select("event_id", "density")


@query("gbt_regressor")
def gbt_regressor(spark, sf):
    return Step("GBMRegressor", features=["value", "hour"], targets=["y"], predictions=["p"], n_estimators=3, max_depth=3).apply(_with_hour(spark, sf), CTX).select("event_id", "p")


@query("gbm_forecast", """with d as (select user_id, date_trunc('day', ts)::timestamp as ts, avg(value) as y from events group by 1, 2),
    g as (select *, ts - lag(ts) over (partition by user_id order by ts) as gap from d),
    l as (select user_id, max(ts) as last, quantile_disc(gap, 0.5) as gap from g group by 1 having count(gap) > 0)
    select user_id, ts, false as ahead from d union all select user_id, last + k * gap, true from l, (select unnest([1, 2]) as k)""")
def gbm_forecast(spark, sf):
    """Daily means two rows beyond each user's data; SQL gives the rows, tests/test_boosting.py the values."""
    daily = events(spark, sf, "value").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("y"))
    step = Step("GBMForecaster", features=["y"], targets=["y"], predictions=["p"], lags=[2, 3], n_estimators=2, max_depth=2, least_rows=3)
    return step.apply(daily, CTX).select("user_id", "ts", F.col("y").isNull().alias("ahead"))


# injected anomalies

_step("anomaly_extreme", "with n as (select *, row_number() over (partition by user_id order by ts) - 1 as n from events), s as (select *, greatest(coalesce(stddev_samp(value) over (partition by user_id, n // 10), 1), 1) as sd from n) select event_id, round(case when n % 10 = 9 then sd * 3 else 0 end, 6) as off from s",
      [("AnomalyGeneratorExtremeValue", {"input_item": "value", "factor": 10, "size": 3, "output_item": "z"}), ("PythonExpression", {"expression": "round(abs(${z} - ${value}), 6)", "output_name": "off"})], "event_id off")
_step("anomaly_no_data", "select event_id, case when (row_number() over (partition by user_id order by ts) - 1) % 10 < 7 then value end as z from events", [("AnomalyGeneratorNoData", {"input_item": "value", "width": 3, "factor": 10, "output_item": "z"})], "event_id z")
_step("anomaly_flatline", "with n as (select *, row_number() over (partition by user_id order by ts) - 1 as n from events) select event_id, case when n % 10 >= 7 then first_value(value) over (partition by user_id, n // 10, n % 10 >= 7 order by ts) else value end as z from n", [("AnomalyGeneratorFlatline", {"input_item": "value", "width": 3, "factor": 10, "output_item": "z"})], "event_id z")

# quality and metrics


@query("dq_constant", "select user_id, case when count(value) > 1 then count(distinct value) <= 1 end as constant_value, case when count(value) > 1 then max(value) <= 1e-7 end as stuck_at_zero, count(value) as n_values from events group by 1")
def dq_constant(spark, sf):
    return quality_checks(events(spark, sf, "value"), ["user_id"], "value", "ts", ["constant_value", "stuck_at_zero"])


@query("dq_series")
def dq_series(spark, sf):
    return quality_checks(events(spark, sf, "value"), ["user_id"], "value", "ts", ["sample_entropy", "stationarity", "white_noise"])


def _metric(name: str, metric: str, sql: str, **options):
    def run(spark, sf):
        df = events(spark, sf, "value").withColumn("p", F.col("user_id") * 1.5)
        return df.groupBy("user_id").agg(F.round(M.METRICS[metric](F.col("value"), F.col("p"), **options), 6).alias("result"))

    query(name, f"with e as (select user_id, value as y, user_id * 1.5::double as p from events) select user_id, round({sql}, 6) as result from e group by 1")(run)


_metric("metric_rmse", "RMSE", "sqrt(avg((p - y) * (p - y)))")
_metric("metric_mae", "MAE", "avg(abs(p - y))")
_metric("metric_nrmse", "NRMSE", "sqrt(avg((p - y) * (p - y))) / abs(avg(y))")
_metric("metric_mape", "MAPE", "avg(abs((p - y) / y)) filter (where y <> 0) * 100")
_metric("metric_smape", "SMAPE", "avg(abs(p - y) / case when (abs(y) + abs(p)) / 2 = 0 then 1e-15 else (abs(y) + abs(p)) / 2 end) * 100")
_metric("metric_wape", "WAPE", "sum(abs(p - y)) / nullif(sum(abs(y)), 0)")
_metric("metric_bias", "Bias", "avg(p - y)")
_metric("metric_cosine", "cosine_similarity", "case when user_id = 0 then null else sum(y * p) / (sqrt(sum(y * y)) * sqrt(sum(p * p))) end")


@query("metric_losses")
def metric_losses(spark, sf):
    df = events(spark, sf, "value").withColumn("p", F.col("value") * 0.9 + 1)
    return M.series_losses(df, ["user_id"], "ts", "value", "p")


# pipelines


@query("flagship", """select user_id, date_trunc('day', ts)::timestamp as ts, round(avg(value), 6) as mean_value, max(value) as max_value, count(*) filter (where value >= 100) as high_alerts
    from events where value is not null group by 1, 2""")
def flagship(spark, sf):
    """Rows to daily metrics and alerts through an entity type's pipeline."""
    daily = [Aggregate("Mean", "value", "mean_value"), Aggregate("Maximum", "value", "max_value"), Aggregate("Count", "high", "high_alerts", {"min_count": 0})]
    kind = EntityType("events", events(spark, sf, "value", "event_type"), "user_id", "ts", {"value": "NUMBER"}, steps=[Step("AlertHighValue", input_item="value", upper_threshold=100, alert_name="high")], aggregates={DAY: daily}, alerts=["high"])
    return CalcPipeline(kind).execute().grains["day"].withColumn("mean_value", F.round("mean_value", 6))


@query("pipeline_derived", """with e as (select user_id, ts, value, case when value > 50 then value - 50 else 0.0 end as excess from events)
    select 'excess' as key, user_id, ts, excess as value_n, null::boolean as value_b from e union all select 'hot', user_id, ts, null, true from e where excess >= 30""")
def pipeline_derived(spark, sf):
    steps = [Step("AlertHighValue", input_item="excess", upper_threshold=30, alert_name="hot"), Step("IfThenElse", conditional_expression="${value} > 50", true_expression="${value} - 50", false_expression="0.0", output_item="excess")]
    kind = EntityType("events", events(spark, sf, "value"), "user_id", "ts", {"value": "NUMBER"}, steps=steps, alerts=["hot"])
    return CalcPipeline(kind).execute().derived.select("key", "user_id", "ts", "value_n", "value_b")


# steps by their catalog names


_VIEWS = "with v as (select event_id, user_id, ts, case when event_type <> 'view' then value end as v from events)"
_GAPS = """, n as (select *, case when v is not null then {'v': v, 't': epoch_us(ts)} end as p from v),
    w as (select *, last_value(p ignore nulls) over (partition by user_id order by ts rows between unbounded preceding and current row) as a,
      first_value(p ignore nulls) over (partition by user_id order by ts rows between current row and unbounded following) as b from n)
    select event_id, round(coalesce(a.v + (b.v - a.v) * ((epoch_us(ts) - a.t) / nullif(b.t - a.t, 0)), a.v), 6) as y from w"""
ORACLE_SQL["interpolate_gaps"] = _VIEWS + _GAPS


@query("interpolator_missing", _VIEWS + _GAPS)
def interpolator_missing(spark, sf):
    df = events(spark, sf).withColumn("v", F.when(F.col("event_type") == "view", -1.0).otherwise(F.col("value")))
    return Step("Interpolator", input_item="v", output_item="y", missing=-1.0).apply(df, CTX).select("event_id", F.round("y", 6).alias("y"))


ORACLE_SQL["occupancy_location"] = """with c as (select user_id, date_trunc('day', ts)::timestamp as ts, event_type as x, user_id % 3 as y, count(*) as n from events where event_type is not null group by all)
    select user_id, ts, to_json({'data': list({'x': x, 'y': y, 'count': n} order by x, y, n)})::varchar as places from c group by 1, 2"""
ORACLE_SQL["agg_histogram"] = """with e as (select user_id, min(value) as a, max(value) as b, count(value) as n, count(*) as rows from events group by 1),
    c as (select user_id, least(floor((value - a) / (b - a) * 10), 9)::int as i, count(*) as c from events join e using (user_id) where b > a group by 1, 2),
    g as (select user_id, n, unnest(range(10)) as i from e where n = rows and b > a),
    h as (select user_id, string_agg(round(coalesce(c, 0) * 10::double / n, 6)::varchar, ',' order by i) as t from g left join c using (user_id, i) group by 1)
    select user_id, coalesce(t, '') as histogram from e left join h using (user_id)"""


@query("time_in_shift", f"""with s as ({ORACLE_SQL['shift_identify']}),
    x as (select event_id, user_id, ts, shift_day, shift_id, shift_start, case shift_id when '1' then shift_start + interval 510 minutes when '2' then shift_start + interval 7 hours else shift_start + interval 510 minutes end as shift_end,
      case when event_type = 'click' then ts end as hit from s join events using (event_id))
    select event_id, round((epoch_us(min(hit) over w) - epoch_us(shift_start)) / 6e7, 6) as time_to_first, round((epoch_us(shift_end) - epoch_us(max(hit) over w)) / 6e7, 6) as time_from_last
    from x window w as (partition by user_id, shift_day, shift_id)""")
def time_in_shift(spark, sf):
    df = Step("IdentifyShiftFromTimestamp", shifts=SHIFTS).apply(events(spark, sf).withColumn("clicked", F.when(F.col("event_type") == "click", F.col("value"))), CTX)
    out = Step("TimeToFirstAndLastInShift", input_item="clicked", bounds=("shift_start", "shift_end")).apply(df, CTX)
    return out.select("event_id", F.round("time_to_first", 6).alias("time_to_first"), F.round("time_from_last", 6).alias("time_from_last"))


@query("shift_split_step", f"select event_id, shift_day as day, shift_id as shift, shift_start, shift_end from ({ORACLE_SQL['shift_split']})")
def shift_split_step(spark, sf):
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("value") * 600_000_000).cast("long") / F.lit(1e6))
    step = Step("SplitDataByActiveShifts", start_timestamp="ts", end_timestamp="e", shifts=SHIFTS, shift_day="day", shift_id="shift")
    return step.apply(events(spark, sf, "event_id", "value").withColumn("e", F.col("ts") + length), CTX).select("event_id", "day", "shift", "shift_start", "shift_end")


def _activity_sql(code: str) -> str:
    return f"""select user_id, greatest(s, p) as ts, round(round((epoch_us(e) - epoch_us(greatest(s, p))) / 1e6) / 60, 6) as minutes from (
      select *, max(e) over (partition by user_id order by s, e desc rows between unbounded preceding and 1 preceding) as p
      from (select user_id, ts as s, ts + to_microseconds(floor(value * 60000000 * 20)::bigint) as e from events where event_type = '{code}')) where p is null or e > p"""


def _activities(spark, sf, *codes):
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("value") * 60_000_000 * 20).cast("long") / F.lit(1e6))
    return events(spark, sf).where(F.col("event_type").isin(*codes)).select("user_id", F.col("event_type").alias("activity"), F.col("ts").alias("start_date"), (F.col("ts") + length).alias("end_date"))


@query("activity_duration", f"with a as ({_activity_sql('click')}) select coalesce(e.user_id, a.user_id) as user_id, coalesce(e.ts, a.ts) as ts, e.event_id, a.minutes from events e full join a on e.user_id = a.user_id and e.ts = a.ts")
def activity_duration(spark, sf):
    ctx = Context("user_id", "ts", tables={"work": _activities(spark, sf, "click", "error")})
    out = Step("ActivityDuration", table_name="work", activity_codes=["click"], activity_duration="minutes").apply(events(spark, sf, "event_id"), ctx)
    return out.select("user_id", "ts", "event_id", F.round("minutes", 6).alias("minutes"))


@query("activity_two_tables", f"""with a as ({_activity_sql('click')}), b as ({_activity_sql('error')}), k as (select user_id, ts from events union select user_id, ts from a union select user_id, ts from b)
    select k.user_id, k.ts, e.event_id, a.minutes as click_minutes, b.minutes as error_minutes from k left join events e using (user_id, ts) left join a using (user_id, ts) left join b using (user_id, ts)""")
def activity_two_tables(spark, sf):
    ctx = Context("user_id", "ts", tables={c: _activities(spark, sf, c) for c in ("click", "error")})
    out = Step("SampleActivityDuration", input_activities=["click", "error"], activity_duration=["click_minutes", "error_minutes"]).apply(events(spark, sf, "event_id"), ctx)
    return out.select("user_id", "ts", "event_id", *(F.round(c, 6).alias(c) for c in ("click_minutes", "error_minutes")))


@query("entity_data", "with s as (select user_id + 1 as user_id, ts, value as other from events where event_type = 'view') select coalesce(e.user_id, s.user_id) as user_id, coalesce(e.ts, s.ts) as ts, e.event_id, s.other from events e full join s on e.user_id = s.user_id and e.ts = s.ts")
def entity_data(spark, sf):
    source = events(spark, sf, "event_type", "value").where("event_type = 'view'").withColumn("owner", F.col("user_id") + 1)
    ctx = Context("user_id", "ts", tables={"source": source})
    return Step("GetEntityData", source_entity_type_name="source", key_map_column="owner", input_items=["value"], output_items=["other"]).apply(events(spark, sf, "event_id"), ctx)


@query("merge_sample_series", "select user_id, ts, event_id, case when event_type = 'view' then value * 2 end as doubled from events")
def merge_sample_series(spark, sf):
    other = events(spark, sf).where("event_type = 'view'").select("user_id", "ts", (F.col("value") * 2).alias("v"))
    ctx = Context("user_id", "ts", tables={"sample_time_series": other})
    return Step("MergeSampleTimeSeries", input_items=["v"], output_items=["doubled"]).apply(events(spark, sf, "event_id"), ctx)


@query("sql_columns", "select event_id, c.n as type_rows, c.top as type_top from events left join (select event_type, count(*) as n, max(value) as top from events where event_type <> 'view' group by 1) c using (event_type)")
def sql_columns(spark, sf):
    sql = f"select event_type, count(*) as n, max(value) as top from parquet.`{sf}/events.parquet` where event_type <> 'view' group by event_type"
    return Step("NewColFromSql", sql=sql, names=["type_rows", "type_top"], join_on="event_type").apply(events(spark, sf, "event_id", "event_type"), CTX).select("event_id", "type_rows", "type_top")


@query("load_and_concat", """select user_id, ts, event_id, null::double as more from events where event_type = 'click'
    union all select user_id, ts, null, value from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and event_type = 'error'""")
def load_and_concat(spark, sf):
    ctx = Context("user_id", "ts", tables={"extra": events(spark, sf)}, start=datetime(2024, 1, 5), end=datetime(2024, 1, 20))
    step = Step("LoadTableAndConcat", table="extra", columns=["value"], names=["more"], where_clause="event_type = 'error'")
    return step.apply(events(spark, sf).where("event_type = 'click'").select("user_id", "ts", "event_id"), ctx)


@query("loader_zones", "select event_id, value * 2 as value, z as zone from events, (values ('+00:00'), ('+02:00')) t(z) where (z = '+00:00') = (event_type = 'view')")
def loader_zones(spark, sf):
    e = events(spark, sf)
    frames = {"+00:00": e.where("event_type = 'view'"), "+02:00": e.where("event_type <> 'view'")}
    out = T.run_loaders(frames, [lambda df: df.withColumn("value", F.col("value") * 2)], "zone")
    return out.select("event_id", "value", "zone")


@query("dimension_rows", "select c_custkey, c_name, c_mktsegment from customer where c_custkey in (1, 5, 9)")
def dimension_rows(spark, sf):
    return T.read_dimension(table(spark, sf, "customer"), [1, 5, 9], ["c_name", "c_mktsegment"], "c_custkey")


@query("sql_read", "select o_orderstatus as status, count(*) as orders, max(o_orderdate)::timestamp as latest from orders group by 1")
def sql_read(spark, sf):
    return T.read_sql(spark, f"select o_orderstatus, count(*) as n, max(o_orderdate) as d from parquet.`{sf}/orders.parquet` group by 1", ["status", "orders", "latest"]).withColumn("latest", F.col("latest").cast("timestamp_ntz"))


@query("delete_input", "select event_id, true as done from events where ts >= timestamp '2024-01-15'")
def delete_input(spark, sf):
    ctx = Context("user_id", "ts", end=datetime(2024, 1, 25))
    return Step("DeleteInputData", older_than_days=10, output_item="done").apply(events(spark, sf, "event_id"), ctx).select("event_id", "done")


@query("no_data_step", f"select user_id, ts, event_id, null::boolean as no_data_alert from events union all select user_id, ts, null, no_data_alert from ({ORACLE_SQL['alert_no_data']})")
def no_data_step(spark, sf):
    return Step("NoDataAlert", duration=24, duration_unit="HOURS", cooldown=12, cooldown_unit="HOURS").apply(events(spark, sf, "event_id"), CTX).select("user_id", "ts", "event_id", F.col("no_data_alert"))


@query("expand_data", """with f as (select user_id, min(ts) as first from events where ts >= timestamp '2024-01-15' group by 1),
    o as (select event_id, row_number() over (partition by user_id order by ts desc) as n from events join f using (user_id) where ts < first)
    select event_id from events where ts >= timestamp '2024-01-15' union all select event_id from o where n <= 2""")
def expand_data(spark, sf):
    e = events(spark, sf)
    ctx = Context("user_id", "ts", tables={"history": e})
    return Step("DataExpanderTransformer", input_items=["value"], history_table="history", limit=2).apply(e.where(F.col("ts") >= F.lit(datetime(2024, 1, 15))), ctx).select("event_id")


for _kind, _item in (("LookupOperator", "operator"), ("LookupStatus", "status")):
    query(f"lookup_{_item}", ORACLE_SQL["scd_asof"].replace("c.state from", f"c.state as {_item} from"))(
        lambda spark, sf, kind=_kind, item=_item: Step(kind).apply(events(spark, sf, "event_id"), Context("user_id", "ts", tables={f"widgets_dimension_{item}": _changes(spark, sf)})).select("event_id", item)
    )

_step("pipeline_expression", "select event_id, value * 3 - 1 as y, value as reading from events", [("PipelineExpression", {"expression": "${value} * 3 - 1", "name": "y"}), ("RenameCols", {"input_names": ["value"], "output_names": ["reading"]})], "event_id y reading")
_simple("agg_hello_world", "HelloWorldAggregator", "max(value) - min(value)", wrap=True, expression="x.max() - x.min()")


@query("agg_several", "select user_id, date_trunc('day', ts)::timestamp as ts, max(value) as value_max, min(value) as least, count(event_id) as event_id_count from events group by 1, 2")
def agg_several(spark, sf):
    return data_aggregator(events(spark, sf, "value", "event_id"), CTX, DAY, {"value": ["max", "min"], "event_id": ["count"]}, {("value", "min"): "least"})


@query("agg_aligned", "select user_id, date_trunc('day', ts)::timestamp as ts, count(*) as n from events where ts >= timestamp '2024-01-06' group by 1, 2")
def agg_aligned(spark, sf):
    df = DAY.align(events(spark, sf, "event_id"), CTX, datetime(2024, 1, 5, 7))
    return aggregate(df, CTX, DAY, [Aggregate("Count", "event_id", "n")])


@query("agg_complex", "select user_id, date_trunc('month', ts)::timestamp as ts, round(max(value) - median(value), 6) as above, count(*) as n from events group by 1, 2")
def agg_complex(spark, sf):
    import pandas as pd

    def spread(pdf):
        return pd.DataFrame({"above": [pdf["value"].max() - pdf["value"].median()], "n": [len(pdf)]})

    return complex_aggregate(events(spark, sf, "value"), CTX, Granularity("m", "MS"), spread, "above double, n long").withColumn("above", F.round("above", 6))


# intervals


def _spells(spark, sf):
    """Property values valid for 8 hours, some from ever and some until now."""
    rows = events(spark, sf).where("event_type in ('purchase', 'error')")
    start, end = F.when(F.col("event_id") % 7 != 0, F.col("ts")), F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("interval 8 hours"))
    return rows.select("user_id", start.alias("start_date"), end.alias("end_date"), F.concat("event_type", "event_id").alias("state"))


_SPELLS = """select user_id, case when event_id % 7 <> 0 then ts end as s, case when event_id % 5 <> 0 then ts + interval 8 hours end as x, event_type || event_id as state
    from events where event_type in ('purchase', 'error')"""


@query("scd_data", f"""with c as ({_SPELLS}) select user_id, s as start_date, x as end_date, state from c
    where (x is null or x >= timestamp '2024-01-05') and (s is null or s < timestamp '2024-01-20 12:00:00')""")
def scd_data_query(spark, sf):
    return I.scd_data(_spells(spark, sf), "user_id", datetime(2024, 1, 5), datetime(2024, 1, 20, 12))


@query("scd_history", f"""with c as ({_SPELLS}), w as (select user_id, date_trunc('day', ts)::timestamp as day_from, max(ts)::timestamp as day_to from events where event_type = 'view' group by 1, 2)
    select w.user_id, day_from, day_to, 'state' as property, state as value, s as valid_from, x as valid_to
    from w join c on w.user_id = c.user_id and (x is null or x >= day_from) and (s is null or s < day_to)""")
def scd_history_query(spark, sf):
    windows = events(spark, sf).where("event_type = 'view'").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day_from")).agg(F.max("ts").alias("day_to"))
    return I.scd_history(windows, {"state": _spells(spark, sf)}, "user_id", ("day_from", "day_to"))


@query("scd_history_step", f"""with c as ({_SPELLS}) select event_id, 'state' as property, state as value
    from events e join c on e.user_id = c.user_id and (x is null or x >= ts) and (s is null or s <= ts)""")
def scd_history_step_query(spark, sf):
    ctx = Context("user_id", "ts", tables={"spells": _spells(spark, sf)})
    return Step("SCDHistory", table_names={"state": "spells"}).apply(events(spark, sf, "event_id"), ctx).select("event_id", "property", "value")
