"""Projections, masks and row filters over one row at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.catalog import Context, listed, operator
from tidewell.functions.expressions import compile_expression


def expression(df: DataFrame, ctx: Context, text: str, name: str) -> DataFrame:
    return df.withColumn(name, compile_expression(text, ctx.constants))


@operator("PythonExpression", outputs=("output_name",), expressions=("expression",))
def python_expression(df, ctx, expression, output_name):
    return df.withColumn(output_name, compile_expression(expression, ctx.constants))


@operator("NewColFromCalculation", outputs=("name",), expressions=("expression",))
def new_col_from_calculation(df, ctx, expression, name, sources=None):
    return df.withColumn(name, compile_expression(expression, ctx.constants))


operator("PipelineExpression", outputs=("name",), expressions=("expression",))(lambda df, ctx, expression, name, entity_type=None: df.withColumn(name, compile_expression(expression, ctx.constants)))


@operator("IfThenElse", outputs=("output_item",), expressions=("conditional_expression", "true_expression", "false_expression"))
def if_then_else(df, ctx, conditional_expression, true_expression, false_expression, output_item="output_item"):
    """A null condition takes the false branch."""
    test, yes, no = (compile_expression(e, ctx.constants) for e in (conditional_expression, true_expression, false_expression))
    return df.withColumn(output_item, F.when(F.coalesce(test, F.lit(False)), yes).otherwise(no))


@operator("ConditionalItems", inputs=("conditional_items",), outputs=("output_items",), expressions=("conditional_expression",))
def conditional_items(df, ctx, conditional_expression, conditional_items, output_items=None):
    test = compile_expression(conditional_expression, ctx.constants)
    names = output_items or [f"conditional_{c}" for c in conditional_items]
    return df.withColumns({n: F.when(test, F.col(c)) for c, n in zip(conditional_items, names)})


@operator("Coalesce", inputs=("data_items",), outputs=("output_item",))
def coalesce(df, ctx, data_items, output_item="output_item"):
    """First non-null value as a number; text that is no number becomes null."""
    return df.withColumn(output_item, F.coalesce(*(F.col(c).cast("string") for c in data_items)).try_cast("double"))


@operator("CoalesceDimension", inputs=("data_items",), outputs=("output_item",))
def coalesce_dimension(df, ctx, data_items, output_item="output_item", strict_numeric=False):
    """First non-null value; texts are kept unless ``strict_numeric``."""
    value = F.coalesce(*(F.col(c) for c in data_items))
    return df.withColumn(output_item, value.cast("string").try_cast("double") if strict_numeric else value)


@operator("Filter", inputs=("sources", "filtered_sources"), outputs=("names",), expressions=("expression",))
def filter_mask(df, ctx, names, filtered_sources, expression, sources=None):
    """Masks columns, never removes rows."""
    mask = F.coalesce(compile_expression(expression, ctx.constants), F.lit(False))
    return df.withColumns({n: F.when(mask, F.col(s)) for n, s in zip(listed(names), listed(filtered_sources))})


def keep_rows(df: DataFrame, condition: Column, flag: str | None) -> DataFrame:
    kept = df.where(condition)
    return kept.withColumn(flag, F.lit(True)) if flag else kept


@operator("BaseFilter", outputs=("output_item",), expressions=("expression",), kind="filter")
def expression_filter(df, ctx, expression, output_item=None, dependent_items=None):
    return keep_rows(df, compile_expression(expression, ctx.constants), output_item)


@operator("CompanyFilter", inputs=("company_code",), outputs=("status_flag",), kind="filter")
def company_filter(df, ctx, company_code, company, status_flag=None):
    return keep_rows(df, F.col(company_code) == company, status_flag)


@operator("StatusFilter", inputs=("status_input_item",), outputs=("output_item",), kind="filter")
def status_filter(df, ctx, status_input_item, include_only, output_item=None):
    return keep_rows(df, F.col(status_input_item) == include_only, output_item)


@operator("EntityFilter", outputs=("output_item",), kind="filter")
def entity_filter(df, ctx, entity_list, output_item=None):
    """The predicate reaches the scan, since nothing is computed before it."""
    return keep_rows(df, F.col(ctx.entity).isin(listed(entity_list)), output_item)


@operator("DropNull", outputs=("output_item",), kind="filter")
def drop_null(df, ctx, exclude_items=None, exclude_cols=None, drop_all_null_rows=True, output_item=None):
    """Drop rows in which every column but keys and the excluded ones is null."""
    spared = {ctx.entity, ctx.timestamp, *listed(exclude_items), *listed(exclude_cols)}
    columns = [c for c in df.columns if c not in spared]
    out = df.dropna(how="all", subset=columns) if drop_all_null_rows and columns else df
    return out.withColumn(output_item, F.lit(True)) if output_item else out


@operator("MultiplyTwoItems", inputs=("input_item_1", "input_item_2"), outputs=("output_item",))
def multiply_two_items(df, ctx, input_item_1, input_item_2, output_item):
    return df.withColumn(output_item, F.col(input_item_1) * F.col(input_item_2))


@operator("MultiplyColumns", inputs=("input_items",), outputs=("output_item",))
def multiply_columns(df, ctx, input_items, output_item="output_item"):
    """Nulls are skipped; a row of nulls gives 1."""
    return df.withColumn(output_item, reduce(lambda a, b: a * b, (F.coalesce(F.col(c).cast("double"), F.lit(1.0)) for c in input_items)))


@operator("MultiplyByFactor", inputs=("input_items",), outputs=("output_items",))
def multiply_by_factor(df, ctx, input_items, factor, output_items):
    return df.withColumns({n: F.col(c) * factor for c, n in zip(input_items, output_items)})


@operator("FlowRateMonitor", inputs=("input_flows", "output_flows"), outputs=("output",))
def flow_rate_monitor(df, ctx, input_flows, output_flows, loss_threshold=0.005, output="output"):
    total = lambda names: reduce(lambda a, b: a + b, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names))
    put_in, out = total(input_flows), total(output_flows)
    return df.withColumn(output, F.coalesce((put_in - out) / F.nullif(put_in, F.lit(0.0)) > loss_threshold, F.lit(False)))


@operator("NegativeRemover", inputs=("sources",), outputs=("names",))
def negative_remover(df, ctx, names, sources):
    return df.withColumns({n: F.when(F.col(s) >= 0, F.col(s)) for n, s in zip(listed(names), listed(sources))})


@operator("OutlierRemover", inputs=("source",), outputs=("name",))
def outlier_remover(df, ctx, name, source, min, max):
    return df.withColumn(name, F.when(F.col(source).between(min, max), F.col(source)))


@operator("InputsAndOutputsOfMultipleTypes", inputs=("input_number", "input_date", "input_str"), outputs=("output_number", "output_date", "output_str"))
def copies_of_types(df, ctx, input_number, input_date, input_str, output_number="output_number", output_date="output_date", output_str="output_str"):
    return df.withColumns({output_number: F.col(input_number), output_date: F.col(input_date), output_str: F.col(input_str)})


@operator("PivotRowsToColumns", inputs=("pivot_by_item", "input_item"), outputs=("output_items",))
def pivot_rows_to_columns(df, ctx, pivot_by_item, pivot_values, input_item=True, null_value=False, output_items=None):
    """Per value a column with the input where the key equals it; rows stay as they are."""
    names = output_items or [f"{pivot_by_item}_{v}" for v in pivot_values]
    value = F.col(input_item) if isinstance(input_item, str) else F.lit(input_item)
    return df.withColumns({n: F.when(F.col(pivot_by_item) == v, value).otherwise(F.lit(null_value)) for v, n in zip(pivot_values, names)})


@operator("TimestampCol", outputs=("output_item",))
def timestamp_col(df, ctx, output_item="timestamp_col", dummy_items=None):
    return df.withColumn(output_item, F.col(ctx.timestamp))


@operator("RenameCols", inputs=("input_names",), outputs=("output_names",))
def rename_cols(df, ctx, input_names, output_names):
    return df.withColumnsRenamed(dict(zip(input_names, output_names)))


#: Coercions of declared types; see ``check_types``.
TYPES = {"NUMBER": "double", "LITERAL": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "JSON": "string"}


def check_types(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Columns coerced to their declared types.

    Booleans may be 0/1 or True/False/None/nan in text; any other value fails the
    query.  A number column from text that is no number becomes null.
    """
    out = {}
    for name, kind in declared.items():
        c, is_now = F.col(name), dict(df.dtypes)[name]
        if kind == "BOOLEAN" and is_now != "boolean":
            t = F.lower(c.cast("string"))
            out[name] = F.when(t.isin("1", "true", "1.0"), True).when(t.isin("0", "false", "0.0"), False).when(t.isNull() | t.isin("none", "nan"), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit(f"{name} is no boolean: "), t)).cast("boolean"))
        elif kind == "NUMBER":
            out[name] = F.nanvl(c.cast("double"), F.lit(None).cast("double")) if is_now in ("double", "float", "boolean", "int", "bigint", "smallint", "tinyint") or is_now.startswith("decimal") else c.cast("string").try_cast("double")
        else:
            out[name] = c.cast(TYPES[kind])
    return df.withColumns(out)


def schema_changes(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns that a step lost or whose type it changed."""
    old, new = dict(before.dtypes), dict(after.dtypes)
    return [f"{c} is gone" for c in old if c not in new] + [f"{c}: {old[c]} became {new[c]}" for c in old if c in new and new[c] != old[c]]
