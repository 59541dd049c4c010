"""Lookups, as-of and interval joins, and merges of series."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.catalog import Context, listed, operator
from tidewell.functions.scalars import micros

#: Rows and bytes of a lookup side that are sent to every task; beyond either both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 a column, and the length of texts and of nested values as text."""
    total = F.lit(8 * len(df.columns))
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif kind in ("array", "map", "struct", "variant"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    return total


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``rows`` rows and ``most`` bytes; reading stops beyond the rows."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(_bytes(df).cast("long"))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most else df


def lookup(df: DataFrame, table: DataFrame, keys: list[str], items: list[str], names: list[str] | None = None) -> DataFrame:
    """Left join of the table's items; a key found several times repeats the row."""
    right = table.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), *(F.col(i).alias(n) for i, n in zip(items, names or items)))
    on = [F.col(k) == F.col(f"_key_{i}") for i, k in enumerate(keys)]
    return df.join(small(right), on, "left").drop(*(f"_key_{i}" for i in range(len(keys))))


@operator("DatabaseLookup", inputs=("lookup_keys",), outputs=("output_items",))
def database_lookup(df, ctx, lookup_table_name, lookup_keys, lookup_items, output_items=None, parse_dates=None):
    table = ctx.table(df.sparkSession, lookup_table_name)
    for c in listed(parse_dates):
        table = table.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return lookup(df, table, listed(lookup_keys), listed(lookup_items), output_items)


#: The companies of the sample table.
COMPANIES = [("ABC", "USD", 100, "2005-02-01 07:00:00"), ("ACME", "CAD", 120, "1988-01-01 05:00:00"), ("JDI", "USD", 352, "1967-02-28 09:00:00")]


@operator("LookupCompany", outputs=("output_items",))
def lookup_company(df, ctx, lookup_items=None, output_items=None, company="company"):
    """currency_code, employee_count and inception_date of the row's company; null for companies unknown."""
    rows = df.sparkSession.createDataFrame(COMPANIES, "code string, currency_code string, employee_count int, inception_date string")
    table = rows.withColumn("inception_date", F.col("inception_date").cast("timestamp_ntz")).withColumnRenamed("code", company)
    return lookup(df, table, [company], listed(lookup_items) or ["currency_code", "employee_count", "inception_date"], output_items)


def asof_join(left: DataFrame, right: DataFrame, entity: str, ts: str, right_ts: str, items: list[str], tolerance: timedelta | None = None, direction: str = "backward") -> DataFrame:
    """Each left row with the items of the entity's last right row at or before it.

    Both sides are put in one ordered stream per entity, so a join costs one shuffle
    and no pairs.  ``forward`` takes the next right row, ``nearest`` the closer of
    both (the earlier on ties).  Rows further than ``tolerance`` give nulls.
    """
    payload = F.struct(*(F.col(i) for i in items), F.col(right_ts).cast("timestamp_ntz").alias("_at"))
    kind = right.select(payload.alias("p")).schema["p"].dataType
    own = F.struct(*(F.col(c) for c in left.columns))
    a = left.select(F.col(entity).alias("_e"), F.col(ts).cast("timestamp_ntz").alias("_t"), own.alias("_row"), F.lit(None).cast(kind).alias("_p"), F.lit(1).alias("_side"))
    b = right.select(F.col(entity).alias("_e"), F.col(right_ts).cast("timestamp_ntz").alias("_t"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_p"), F.lit(0).alias("_side"))
    both = a.unionByName(b.where(F.col("_t").isNotNull()))
    before = F.last("_p", ignorenulls=True).over(Window.partitionBy("_e").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_p", ignorenulls=True).over(Window.partitionBy("_e").orderBy("_t", F.col("_side").desc()).rowsBetween(0, Window.unboundedFollowing))
    picked = {"_b": before, "_f": after}
    if direction == "backward":
        picked.pop("_f")
    elif direction == "forward":
        picked.pop("_b")
    out = both.withColumns(picked).where("_side = 1")
    far = lambda c: F.abs(micros(F.col("_t")) - micros(c["_at"]))
    if direction == "nearest":
        nearer = F.when(F.col("_b").isNull() | (far(F.col("_f")) < far(F.col("_b"))), F.col("_f")).otherwise(F.col("_b"))
        out = out.withColumn("_b", nearer)
    found = F.col("_f") if direction == "forward" else F.col("_b")
    if tolerance is not None:
        found = F.when(far(found) <= int(tolerance.total_seconds() * 1e6), found)
    return out.withColumn("_found", found).select("_row.*", *(F.col(f"_found.{i}").alias(i) for i in items))


@operator("SCDLookup", outputs=("output_item",))
def scd_lookup(df, ctx, table_name, output_item=None, property_name=None, start_name="start_date", tolerance=None):
    """The property's last change at or before the event; end dates are not read."""
    changes = ctx.table(df.sparkSession, table_name)
    prop = property_name or next(c for c in changes.columns if c not in (ctx.entity, start_name, "end_date"))
    right = changes.select(F.col(ctx.entity), F.col(start_name).alias("_start"), F.col(prop).alias(output_item or prop))
    return asof_join(df, right, ctx.entity, ctx.timestamp, "_start", [output_item or prop], tolerance)


operator("LookupOperator", outputs=("output_item",))(lambda df, ctx, dummy_item=None, output_item="operator", table_name="widgets_dimension_operator": scd_lookup(df, ctx, table_name, output_item))
operator("LookupStatus", outputs=("output_item",))(lambda df, ctx, dummy_item=None, output_item="status", table_name="widgets_dimension_status": scd_lookup(df, ctx, table_name, output_item))


def coalesce_columns(df: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}{suffix}")) for c in columns}).drop(*(f"{c}{suffix}" for c in columns))


def merge_series(left: DataFrame, right: DataFrame, ctx: Context, method: str = "outer", tolerance: timedelta | None = timedelta(days=1), direction: str = "backward") -> DataFrame:
    """Another series merged in.

    ``outer``: full join on entity and time, overlapping columns from the left where
    not null; ``nearest``: as-of per entity within ``tolerance``; ``concat``: all rows
    of both; ``replace``: the other series alone.
    """
    if method == "replace":
        return right
    if method == "concat":
        return left.unionByName(right, allowMissingColumns=True)
    keys = [ctx.entity, ctx.timestamp]
    if method == "nearest":
        items = [c for c in right.columns if c not in keys]
        other = right.withColumnRenamed(ctx.timestamp, "_rts")
        return asof_join(left.drop(*items), other, ctx.entity, ctx.timestamp, "_rts", items, tolerance, direction)
    both = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.withColumnsRenamed({c: f"{c}_other" for c in both})
    return coalesce_columns(left.join(renamed, keys, "full"), both, "_other")


@operator("MergeSampleTimeSeries", outputs=("output_items",), kind="source")
def merge_sample_time_series(df, ctx, input_items, output_items=None, table_name="sample_time_series", merge_method="outer"):
    other = ctx.table(df.sparkSession, table_name).select(ctx.entity, ctx.timestamp, *(F.col(i).alias(n) for i, n in zip(listed(input_items), listed(output_items) or listed(input_items))))
    return merge_series(df, other, ctx, merge_method)


@operator("GetEntityData", outputs=("output_items",), kind="source")
def get_entity_data(df, ctx, source_entity_type_name, key_map_column, input_items, output_items=None):
    """Another entity type's series, its entity read from ``key_map_column``."""
    source = ctx.table(df.sparkSession, source_entity_type_name)
    names = listed(output_items) or listed(input_items)
    other = source.select(F.col(key_map_column).alias(ctx.entity), ctx.timestamp, *(F.col(i).alias(n) for i, n in zip(listed(input_items), names)))
    return merge_series(df, other, ctx, "outer")


@operator("NewColFromSql", outputs=("names",))
def new_col_from_sql(df, ctx, sql, names, join_on, index_col=None, parse_dates=None):
    """A query's columns by a left join; its columns after the keys get ``names`` in order."""
    found = df.sparkSession.sql(sql)
    keys = listed(join_on)
    items = [c for c in found.columns if c not in keys]
    return lookup(df, found, keys, items, listed(names))


@operator("NewColFromScalarSql", outputs=("name",))
def new_col_from_scalar_sql(df, ctx, sql, name):
    """The one value of a query as a column; more rows or columns are an error."""
    found = df.sparkSession.sql(sql)
    rows = found.limit(2).collect()
    if len(found.columns) != 1 or len(rows) != 1:
        raise ValueError("the query must return one row of one column")
    return df.withColumn(name, F.lit(rows[0][0]))


def data_merge(df: DataFrame, result, keys: list[str], name: str | None = None, strategy: str | None = None) -> DataFrame:
    """A step's result merged into the frame.

    Scalars become constants.  ``replace`` takes the result, ``skip`` the frame,
    ``slice`` its columns for equal keys, ``outer`` a full join that coalesces, and
    ``lookup`` a left join on the first key.
    """
    if not isinstance(result, DataFrame):
        return df.withColumn(name, F.lit(result))
    strategy = strategy or ("outer" if set(keys) <= set(result.columns) else "lookup")
    if strategy in ("replace", "skip"):
        return result if strategy == "replace" else df
    on = keys if strategy in ("slice", "outer") else [k for k in keys if k in result.columns][:1]
    both = [c for c in result.columns if c in df.columns and c not in on]
    if strategy != "outer":
        return df.drop(*both).join(result, on, "left")
    renamed = result.withColumnsRenamed({c: f"{c}_new" for c in both})
    joined = df.join(renamed, on, "full")
    return joined.withColumns({c: F.coalesce(f"{c}_new", c) for c in both}).drop(*(f"{c}_new" for c in both))


def subquery_join(left: DataFrame, right: DataFrame, on: list[str], right_items: list[str] | None = None, filters: dict | None = None) -> DataFrame:
    """Rows of ``left`` that ``right`` holds the keys of; with items, an inner join that adds them."""
    for c, values in (filters or {}).items():
        left = left.where(F.col(c).isin(*listed(values)))
    return left.join(right.select(*on, *right_items), on) if right_items else left.join(right.select(*on), on, "left_semi")


def compare_frames(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows in one frame only, with ``side`` telling which."""
    a, b = (d.select(*(columns or left.columns)) for d in (left, right))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def is_mergeable(result: DataFrame, df: DataFrame, keys: list[str]) -> bool:
    """Whether ``result`` has the frame's number of rows and only its keys."""
    return result.count() == df.count() and not result.join(df, keys, "left_anti").take(1)
