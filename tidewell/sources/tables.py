"""Scans with pushed-down filters, and sinks for frames, derived metrics and alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.catalog import Context, listed, operator

# scans


def open_table(spark: SparkSession, source: str, kind: str = "parquet", **options) -> DataFrame:
    """A table of the catalog (kind table), files (parquet, csv, json, orc, text), or jdbc."""
    if kind == "table":
        return spark.table(source)
    if kind == "jdbc":
        return spark.read.format("jdbc").options(dbtable=source, **options).load()
    reader = spark.read.options(**({"header": True, "inferSchema": True} if kind == "csv" else {}), **options)
    return reader.format(kind).load(source)


def scan(
    table: DataFrame, columns: list[str] | None = None, aliases: list[str] | None = None, timestamp_col: str | None = None, start_ts=None, end_ts=None,
    entities: list | None = None, dimension: DataFrame | None = None, filters: dict | None = None, deviceid_col: str = "deviceid", end_inclusive: bool = False,
) -> DataFrame:
    """Rows of a window and of some entities, with the dimension's attributes.

    The end bound is exclusive unless told otherwise.  A filter of one member is an
    equality, of several a membership, of none nothing.
    """
    df = table
    if timestamp_col and start_ts is not None:
        df = df.where(F.col(timestamp_col) >= F.lit(start_ts))
    if timestamp_col and end_ts is not None:
        df = df.where(F.col(timestamp_col) <= F.lit(end_ts) if end_inclusive else F.col(timestamp_col) < F.lit(end_ts))
    if entities:
        df = df.where(F.col(deviceid_col).isin(*entities))
    if dimension is not None:
        from tidewell.operators.joins import small

        attributes = [c for c in dimension.columns if c == deviceid_col or c not in df.columns]
        df = df.join(small(dimension.select(*attributes)), deviceid_col, "left")
    for name, members in (filters or {}).items():
        members = listed(members) if not isinstance(members, (int, float, bool)) else [members]
        if members:
            df = df.where(F.col(name) == members[0] if len(members) == 1 else F.col(name).isin(*members))
    if columns:
        df = df.select(*(F.col(c).alias(a) for c, a in zip(columns, aliases or columns)))
    return df


def read_dimension(dimension: DataFrame, entities: list | None = None, columns: list[str] | None = None, deviceid_col: str = "deviceid", parse_dates: list[str] | None = None) -> DataFrame:
    df = dimension.where(F.col(deviceid_col).isin(*entities)) if entities else dimension
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in parse_dates or []})
    return df.select(deviceid_col, *columns) if columns else df


def read_sql(spark: SparkSession, sql: str, names: list[str] | None = None, parse_dates: list[str] | None = None) -> DataFrame:
    df = spark.sql(sql)
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in parse_dates or []})
    return df.toDF(*names) if names else df


def column_kinds(df: DataFrame, exclude: list[str] | None = None, known_categoricals: set[str] | None = None) -> dict[str, list[str]]:
    """Columns by kind: metrics, dates, categoricals and others."""
    out: dict[str, list[str]] = {"metrics": [], "dates": [], "categoricals": [], "others": []}
    for f in df.schema:
        if f.name in (exclude or []):
            continue
        kind = "others"
        if f.name in (known_categoricals or set()) or isinstance(f.dataType, (T.StringType, T.BooleanType)):
            kind = "categoricals"
        elif isinstance(f.dataType, T.NumericType):
            kind = "metrics"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kind = "dates"
        out[kind].append(f.name)
    return out


def check_row_limit(df: DataFrame, limit: int = 1_000_000) -> bool:
    """Whether a query has no more than ``limit`` rows; counting stops beyond."""
    return df.limit(limit + 1).count() <= limit


@operator("LoadTableAndConcat", outputs=("names",), kind="source")
def load_table_and_concat(df, ctx, table, columns, names=None, where_clause=None, parse_dates=None, id_col=None, timestamp_col=None):
    """Rows of another table in the run's window, after those of the frame."""
    more = scan(ctx.table(df.sparkSession, table), timestamp_col=timestamp_col or ctx.timestamp, start_ts=ctx.start, end_ts=ctx.end)
    more = more.where(where_clause) if where_clause else more
    more = more.select(F.col(id_col or ctx.entity).alias(ctx.entity), F.col(timestamp_col or ctx.timestamp).alias(ctx.timestamp), *(F.col(c).alias(n) for c, n in zip(listed(columns), listed(names) or listed(columns))))
    more = more.withColumns({c: F.col(c).cast("timestamp_ntz") for c in listed(parse_dates)})
    return df.unionByName(more, allowMissingColumns=True)


def run_loaders(frames: dict[str, DataFrame], stages: list, offset_column: str = "offset") -> DataFrame:
    """Loader stages over frames of several time zones, kept as one frame with the zone's offset."""
    out = None
    for offset, df in frames.items():
        for stage in stages:
            df = stage(df)
        df = df.withColumn(offset_column, F.lit(offset))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# table schemas, as DDL


def series_schema(metrics: dict[str, str]) -> str:
    base = "deviceid string, evt_timestamp timestamp_ntz, devicetype string, logicalinterface_id string, eventtype string, format string, updated_utc timestamp_ntz"
    return ", ".join([base, *(f"`{n}` {k}" for n, k in metrics.items())])


ACTIVITY = "deviceid string, start_date timestamp_ntz, end_date timestamp_ntz, activity string"
RESOURCE_CALENDAR = "deviceid string, start_date timestamp_ntz, end_date timestamp_ntz, resource_id string"
JOB_LOG = "object_type string, object_name string, schedule string, execution_date timestamp_ntz, previous_execution_date timestamp_ntz, next_execution_date timestamp_ntz, status string, startup_log string, execution_log string, trace string"


#: A log has a time of its own and whatever else it is given.
SYSTEM_LOG = "timestamp_utc timestamp_ntz"


def dimension_schema(attributes: dict[str, str]) -> str:
    """Attributes of entities that don't change."""
    return ", ".join(["deviceid string", *(f"`{n}` {k}" for n, k in attributes.items())])


def system_log_schema(more: dict[str, str]) -> str:
    return ", ".join([SYSTEM_LOG, *(f"`{n}` {k}" for n, k in more.items())])


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def change_schema(prop: str, kind: str = "string") -> str:
    return f"deviceid string, start_date timestamp_ntz, end_date timestamp_ntz, `{prop}` {kind}"


def create_table(spark: SparkSession, name: str, schema: str | T.StructType, if_missing: bool = True) -> None:
    if not (if_missing and spark.catalog.tableExists(name)):
        spark.createDataFrame([], schema).write.saveAsTable(name)


def drop_table(spark: SparkSession, name: str, recreate: bool = False) -> None:
    schema = spark.table(name).schema if recreate and spark.catalog.tableExists(name) else None
    spark.sql(f"drop table if exists {name}")
    if schema is not None:
        create_table(spark, name, schema)


def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"truncate table {name}")


# sinks


def write_frame(df: DataFrame, table: str, if_exists: str = "append", version: datetime | None = None, columns: list[str] | None = None) -> None:
    """A frame to a table; appended columns must be the table's, those it lacks become null."""
    out = df.select(*columns) if columns else df
    if version is not None:
        out = out.withColumn("version_date", F.lit(version).cast("timestamp_ntz"))
    spark = df.sparkSession
    if if_exists == "append" and spark.catalog.tableExists(table):
        there = spark.table(table).schema
        unknown = set(out.columns) - set(there.names)
        if unknown:
            raise ValueError(f"{table} has no columns {sorted(unknown)}")
        out = out.select(*((F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in there))
    out.write.mode("append" if if_exists == "append" else "overwrite").saveAsTable(table)


def replace_where(df: DataFrame, table_path: str, partition: str) -> None:
    """Overwrite the partitions that ``df`` has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table_path)


def delete_older(df: DataFrame, timestamp: str, older_than_days: int, now: datetime) -> DataFrame:
    """The rows that stay; written back by partition overwrite."""
    return df.where(F.col(timestamp) >= F.lit(now - timedelta(days=older_than_days)))


@operator("SamplePreLoad", outputs=("output_item",), kind="preload")
def log_start(df, ctx, dummy_items=None, output_item=None, table_name="sample_pre_load"):
    """A row in a log table that tells of the run's start."""
    spark = df.sparkSession
    create_table(spark, table_name, system_log_schema({"status": "string"}))
    write_frame(spark.createDataFrame([(ctx.launch or datetime.now(), "True")], system_log_schema({"status": "string"})), table_name)
    return df.withColumn(output_item, F.lit(True)) if output_item else df


@operator("DeleteInputData", outputs=("output_item",), kind="preload")
def delete_input_data(df, ctx, older_than_days, output_item=None, dummy_items=None):
    out = delete_older(df, ctx.timestamp, older_than_days, ctx.end or datetime.now())
    return out.withColumn(output_item, F.lit(True)) if output_item else out


@operator("WriteDataFrame", inputs=("input_items",), outputs=("output_status",), kind="sink")
def write_data_frame(df, ctx, input_items, out_table_name, output_status="output_status"):
    write_frame(df.select(ctx.entity, ctx.timestamp, *listed(input_items)), out_table_name)
    return df.withColumn(output_status, F.lit(True))


@operator("SaveDataFrame", inputs=("columns",), outputs=("output_item",), kind="sink")
def save_data_frame(df, ctx, filename, columns=None, output_item="save_df_result"):
    (df.select(*listed(columns)) if columns else df).write.mode("overwrite").parquet(filename)
    return df.withColumn(output_item, F.lit(True))


@operator("DataWriterFile", kind="sink")
def write_csv(df, ctx, path):
    df.write.mode("overwrite").option("header", True).csv(path)
    return df


_VALUE = {"value_n": T.NumericType, "value_b": T.BooleanType, "value_t": (T.TimestampType, T.TimestampNTZType, T.DateType), "value_s": T.StringType}


def _slot(kind: T.DataType, json: bool) -> str:
    return "value_c" if json else next((v for v, k in _VALUE.items() if isinstance(kind, k)), "value_c")


def to_long(df: DataFrame, keys: list[str], items: list[str], json_items: list[str] | None = None, drop_non_finite: bool = False) -> DataFrame:
    """Derived metrics in long form: key, the keys, and one value column per type.

    Nulls give no row.  A number that is not finite becomes a null value, or with
    ``drop_non_finite`` no row.
    """
    types = {"value_n": "double", "value_s": "string", "value_b": "boolean", "value_t": "timestamp_ntz", "value_c": "string"}

    def row(item: str) -> Column:
        slot = _slot(df.schema[item].dataType, item in (json_items or []))
        value = F.col(item).cast(types[slot]) if slot != "value_c" or item in (json_items or []) else F.to_json(F.col(item))
        if slot == "value_n":
            value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
        there = F.col(item).isNotNull() if not drop_non_finite or slot != "value_n" else value.isNotNull()
        return F.when(there, F.struct(F.lit(item).alias("key"), *((value if s == slot else F.lit(None)).cast(t).alias(s) for s, t in types.items())))

    rows = df.select(*keys, F.explode(F.array_compact(F.array(*(row(i) for i in items)))).alias("_r"))
    return rows.select("_r.key", *keys, *(f"_r.{s}" for s in types))


def from_long(long: DataFrame, keys: list[str], items: dict[str, str]) -> DataFrame:
    """The wide frame again; ``items`` maps each key to its value column."""
    picked = [F.max(F.when(F.col("key") == i, F.col(s))).alias(i) for i, s in items.items()]
    return long.where(F.col("key").isin(*items)).groupBy(*keys).agg(*picked)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table after an upsert, and the rows that changed it; unchanged rows are left alone."""
    values = [c for c in new.columns if c not in keys]
    old = stored.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in values))
    cond = [new[k].eqNullSafe(old[k]) for k in keys]
    joined = new.join(old.withColumn("_there", F.lit(True)), cond, "left")
    same = F.coalesce(F.col("_there"), F.lit(False))
    for c in values:
        same = same & new[c].eqNullSafe(F.col(f"_old_{c}"))
    changed = joined.where(~same).select(*(new[c] for c in new.columns))
    kept = stored.join(new.select(*(F.col(k).alias(f"_k_{k}") for k in keys)), [stored[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True), changed


def replace_window(stored: DataFrame, new: DataFrame, timestamp: str, start, end) -> DataFrame:
    """The table with the window [start, end] of the keys in ``new`` rewritten."""
    keys = new.select("key").distinct()
    inside = (F.col(timestamp) >= F.lit(start)) & (F.col(timestamp) <= F.lit(end))
    outside = stored.where(~inside)
    others = stored.where(inside).join(keys, "key", "left_anti")
    return outside.unionByName(others, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)


@operator("PersistColumns", inputs=("items",), kind="sink")
def persist_columns(df, ctx: Context, items, path, dimensions=()):
    """Upsert the items in long form into Parquet at ``path``, partitioned by key."""
    spark, keys = df.sparkSession, [ctx.entity, ctx.timestamp, *dimensions]
    long = to_long(df, keys, listed(items), drop_non_finite=True)
    try:
        stored = spark.read.schema(long.schema).parquet(path)
    except Exception as e:  # no such folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], long.schema)
    merged, _ = upsert(stored.join(long.select("key").distinct(), "key", "left_semi"), long, ["key", *keys])
    from tidewell.sources.staging import staged

    replace_where(staged(merged), path, "key")
    return df
