"""The operator catalog: named steps with declared inputs and outputs.

``operator`` registers a function ``f(df, ctx, **parameters) -> DataFrame`` under a
name.  ``Step`` binds parameters to it; the planner orders steps by what they read
and write, and scope, null handling and merging are done once for all of them.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.expressions import compile_expression, names_in


@dataclass
class Context:
    """What a step may need besides its frame: key names, constants, tables and the run's window."""

    entity: str = "entity_id"
    timestamp: str = "ts"
    constants: dict[str, Any] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    start: datetime | None = None
    end: datetime | None = None
    launch: datetime | None = None
    settings: dict[str, Any] = field(default_factory=dict)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else spark.table(name)


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    expressions: tuple[str, ...]
    kind: str


CATALOG: dict[str, Operator] = {}
_MODULES = (
    "tidewell.functions.transforms", "tidewell.functions.scalars", "tidewell.functions.random_values", "tidewell.operators.alerts",
    "tidewell.operators.joins", "tidewell.operators.intervals", "tidewell.operators.windows", "tidewell.operators.shifts", "tidewell.operators.activities",
    "tidewell.operators.anomaly", "tidewell.operators.density", "tidewell.operators.models", "tidewell.operators.generators", "tidewell.sources.tables", "tidewell.sources.alert_table", "tidewell.plans.controls",
)


def operator(name: str, inputs: Iterable[str] = (), outputs: Iterable[str] = (), expressions: Iterable[str] = (), kind: str = "transformer"):
    """Register a step; ``inputs`` and ``outputs`` name the parameters that hold item names."""

    def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        CATALOG[name] = Operator(name, run, tuple(inputs), tuple(outputs), tuple(expressions), kind)
        return run

    return add


def load_catalog() -> dict[str, Operator]:
    """Import the modules that register operators and return all of them."""
    for module in _MODULES:
        importlib.import_module(module)
    return CATALOG


def listed(value: Any) -> list:
    """A value as a list: None as empty, a string as one name."""
    return [] if value is None else [value] if isinstance(value, str) else list(value)


class Step:
    """A catalog operator with its parameters, and optionally a scope of rows it applies to."""

    def __init__(self, operator_name: str, /, scope: dict | str | None = None, **parameters: Any):
        self.operator = load_catalog()[operator_name]
        self.scope, self.parameters = scope, parameters

    def __repr__(self) -> str:
        return f"Step({self.operator.name}, {self.parameters})"

    @property
    def outputs(self) -> list[str]:
        return [n for p in self.operator.outputs for n in listed(self.parameters.get(p))]

    @property
    def inputs(self) -> set[str]:
        found = {n for p in self.operator.inputs for n in listed(self.parameters.get(p))}
        for p in self.operator.expressions:
            for e in listed(self.parameters.get(p)):
                found |= names_in(e)
        if isinstance(self.scope, str):
            found |= names_in(self.scope)
        elif self.scope:
            found |= set(self.scope)
        return found

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        """Run the step; with a scope, its outputs are null on rows outside it."""
        out = self.operator.run(df, ctx, **self.parameters)
        if self.scope is None or self.operator.kind != "transformer":
            return out
        mask = scope_mask(self.scope, ctx)
        return out.withColumns({c: F.when(mask, F.col(c)) for c in self.outputs if c in out.columns})


NULL_NAMES = ("None", "np.nan", "np.Nat")


def scope_mask(scope: dict | str, ctx: Context) -> Column:
    """A scope as a condition that is never null.

    A mapping from dimension to accepted values (None and its spellings mean null)
    is the conjunction over dimensions of the disjunction over values; a string is
    an expression.
    """
    if isinstance(scope, str):
        return F.coalesce(compile_expression(scope, ctx.constants).cast("boolean"), F.lit(False))
    mask = F.lit(True)
    for name, values in scope.items():
        values = listed(values) if not isinstance(values, (int, float, bool)) else [values]
        if not values:
            continue
        real = [v for v in values if v is not None and v not in NULL_NAMES]
        one = F.coalesce(F.col(name).isin(*real), F.lit(False)) if real else F.lit(False)
        if len(real) < len(values):
            one = one | F.col(name).isNull()
        mask = mask & one
    return mask
