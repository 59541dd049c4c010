"""Steps that report or stop a run."""

from __future__ import annotations

import importlib.metadata
import json

import pandas as pd
from pyspark.sql import functions as F

from tidewell.catalog import listed, operator


@operator("RaiseError", outputs=("output_item",))
def raise_error(df, ctx, halt_after=None, abort_execution=True, output_item="raised"):
    if abort_execution:
        raise RuntimeError(f"the run was asked to stop after {halt_after}")
    return df.withColumn(output_item, F.lit(True))


@operator("PackageInfo", outputs=("version_output",))
def package_info(df, ctx, package_names, version_output=None, **_):
    """Versions of installed packages; nothing is installed."""
    names = listed(version_output) or [f"{p}_package_version" for p in listed(package_names)]
    found = {}
    for p, n in zip(listed(package_names), names):
        try:
            found[n] = F.lit(importlib.metadata.version(p))
        except importlib.metadata.PackageNotFoundError:
            found[n] = F.lit(None).cast("string")
    return df.withColumns(found)


@operator("TraceConstants", outputs=("output_item",))
def trace_constants(df, ctx, output_item="trace_constants", dummy_items=None):
    """The constants as JSON in a column and in the run's trace."""
    text = json.dumps({k: str(v) for k, v in sorted(ctx.constants.items())})
    ctx.settings.setdefault("trace", []).append(text)
    return df.withColumn(output_item, F.lit(text))


@operator("CalcSettings", kind="settings")
def calc_settings(df, ctx, **settings):
    ctx.settings.update({k: v for k, v in settings.items() if v is not None})
    return df


@operator("PythonFunction", inputs=("input_items",), outputs=("output_item",))
def python_function(df, ctx, function, input_items, output_item, parameters=None, kind="double"):
    """``function(frame of inputs, parameters) -> series`` on batches; a callable or its registered name.

    Source text is not executed.
    """
    call = FUNCTIONS[function] if isinstance(function, str) else function
    inputs = listed(input_items)

    @F.pandas_udf(kind)
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(call(rows, parameters or {}))

    return df.withColumn(output_item, run(F.struct(*inputs)))


#: Vetted functions by name, for ``PythonFunction``.
FUNCTIONS: dict = {}


def make_function(name: str, function) -> None:
    FUNCTIONS[name] = function


operator("StoredFunction", inputs=("input_items",), outputs=("output_item",))(lambda df, ctx, function_name, input_items, output_item=None, parameters=None: python_function(df, ctx, function_name, input_items, output_item or function_name, parameters))


def apply_per_group(df, keys: list[str], function, schema: str):
    """``function(pandas frame) -> pandas frame`` of each whole group."""
    return df.groupBy(*keys).applyInPandas(function, schema)
