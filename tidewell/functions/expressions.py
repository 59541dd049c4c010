"""Expressions over items, compiled to Columns without evaluating any code.

The grammar is a subset of Python: ``${item}``, ``df['item']`` and bare names read
items, ``c['name']`` reads a constant; arithmetic, comparisons, ``& | ~ and or not``,
``a if c else b``, ``in``; calls of the functions and methods listed below.  In an
aggregate expression ``x``, ``${GROUP}`` and items may be reduced by methods such as
``.max()``.  Division by zero gives null.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = re.compile(r"\$\{\s*([^}]+?)\s*\}")

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor,
    "ceil": F.ceil, "power": F.pow, "sign": F.signum, "isnan": lambda c: c.isNull() | F.isnan(c.cast("double")), "isnull": F.isnull, "isna": F.isnull,
    "notnull": F.isnotnull, "round": lambda c, n=0: F.bround(c, n), "where": lambda c, a, b: F.when(F.coalesce(c, F.lit(False)), a).otherwise(b),
    "maximum": F.greatest, "minimum": F.least, "max": F.greatest, "min": F.least, "lower": F.lower, "upper": F.upper, "len": F.length,
    "to_datetime": F.to_timestamp_ntz, "str": lambda c: c.cast("string"), "float": lambda c: c.cast("double"), "int": lambda c: c.cast("long"),
}

METHODS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "isnull": F.isnull, "isna": F.isnull, "notnull": F.isnotnull, "notna": F.isnotnull, "fillna": lambda c, v: F.coalesce(c, _lit(v)),
    "round": lambda c, n=0: F.bround(c, n), "between": lambda c, a, b: c.between(a, b), "isin": lambda c, *v: c.isin(*[w for x in v for w in (x if isinstance(x, list) else [x])]),
    "clip": lambda c, lower=None, upper=None: F.least(F.greatest(c, _lit(lower)) if lower is not None else c, _lit(upper)) if upper is not None else F.greatest(c, _lit(lower)),
    "contains": lambda c, v: c.contains(v), "startswith": lambda c, v: c.startswith(v), "endswith": lambda c, v: c.endswith(v), "lower": F.lower, "upper": F.upper,
    "astype": lambda c, t: c.cast({"float": "double", "int": "long", "str": "string", "bool": "boolean"}.get(t, t)),
}

AGGREGATES: dict[str, Callable[..., Column]] = {
    "max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "count": F.count,
    "nunique": F.count_distinct, "prod": F.product, "quantile": lambda c, q=0.5: F.percentile(c, q), "any": lambda c: F.bool_or(c.cast("boolean")),
    "all": lambda c: F.bool_and(c.cast("boolean")), "skew": F.skewness, "kurt": F.kurtosis,
}

PARTS = {"hour": F.hour, "minute": F.minute, "second": F.second, "day": F.dayofmonth, "month": F.month, "year": F.year, "dayofweek": F.weekday, "dayofyear": F.dayofyear}

_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(_lit(a).cast("double"), _lit(b).cast("double")), ast.Mod: lambda a, b: F.pmod(_lit(a), _lit(b)),
    ast.Pow: lambda a, b: F.pow(_lit(a), _lit(b)), ast.FloorDiv: lambda a, b: F.floor(F.try_divide(_lit(a).cast("double"), _lit(b).cast("double"))), ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b, ast.BitXor: lambda a, b: a != b,
}
_COMPARE = {
    ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a.isNull() if b is None else a == b, ast.NotEq: lambda a, b: a.isNotNull() if b is None else a != b,
    ast.Is: lambda a, b: a.isNull(), ast.IsNot: lambda a, b: a.isNotNull(), ast.In: lambda a, b: a.isin(b), ast.NotIn: lambda a, b: ~a.isin(b),
}


def _lit(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def parse(expression: str) -> ast.expr:
    """The syntax tree, with ``${item}`` read as ``df['item']``."""
    return ast.parse(ITEM.sub(lambda m: f"df[{m[1]!r}]", expression.strip()), mode="eval").body


def names_in(expression: str) -> set[str]:
    """Items that an expression reads."""
    found = set()
    for node in ast.walk(parse(expression)):
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "df" and isinstance(node.slice, ast.Constant):
            found.add(node.slice.value)
        elif isinstance(node, ast.Name) and node.id not in ("df", "c", "np", "pd", "x", "True", "False", "None") and node.id not in FUNCTIONS:
            found.add(node.id)
    return found - {"GROUP"}


class _Compiler:
    def __init__(self, constants: dict, group: Column | None):
        self.constants, self.group = constants, group

    def item(self, name: str) -> Column:
        if self.group is not None and name in ("x", "GROUP"):
            return self.group
        return F.col(f"`{name}`")

    def visit(self, node: ast.expr) -> Any:
        found = getattr(self, f"visit_{type(node).__name__}", None)
        if found is None:
            raise ValueError(f"not supported in an expression: {ast.unparse(node)}")
        return found(node)

    def visit_Constant(self, node):
        return node.value

    def visit_List(self, node):
        return [self.visit(x) for x in node.elts]

    visit_Tuple = visit_List

    def visit_Name(self, node):
        return self.item(node.id)

    def visit_Subscript(self, node):
        owner = node.value.id if isinstance(node.value, ast.Name) else None
        key = self.visit(node.slice)
        if owner == "df":
            return self.item(key)
        if owner == "c":
            return self.constants[key]
        raise ValueError(f"not supported in an expression: {ast.unparse(node)}")

    def visit_BinOp(self, node):
        a, b = self.visit(node.left), self.visit(node.right)
        if not isinstance(a, Column) and not isinstance(b, Column):
            a = _lit(a)
        return _BINARY[type(node.op)](a, b)

    def visit_UnaryOp(self, node):
        value = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            return -value
        return value if isinstance(node.op, ast.UAdd) else ~_lit(value)

    def visit_BoolOp(self, node):
        out = _lit(self.visit(node.values[0]))
        for more in node.values[1:]:
            out = out & _lit(self.visit(more)) if isinstance(node.op, ast.And) else out | _lit(self.visit(more))
        return out

    def visit_Compare(self, node):
        out, left = None, self.visit(node.left)
        for op, right in zip(node.ops, node.comparators):
            right = self.visit(right)
            one = _COMPARE[type(op)](_lit(left), right)
            out, left = one if out is None else out & one, right
        return out

    def visit_IfExp(self, node):
        return F.when(F.coalesce(_lit(self.visit(node.test)), F.lit(False)), _lit(self.visit(node.body))).otherwise(_lit(self.visit(node.orelse)))

    def visit_Attribute(self, node):
        if isinstance(node.value, ast.Name) and node.value.id in ("np", "pd"):
            return {"nan": None, "NaT": None, "pi": 3.141592653589793, "e": 2.718281828459045}[node.attr]
        owner = node.value.value if isinstance(node.value, ast.Attribute) and node.value.attr == "dt" else node.value
        if node.attr in PARTS:
            return PARTS[node.attr](self.visit(owner))
        raise ValueError(f"not supported in an expression: {ast.unparse(node)}")

    def visit_Call(self, node):
        args = [self.visit(x) for x in node.args]
        options = {k.arg: self.visit(k.value) for k in node.keywords}
        if isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS:
            return FUNCTIONS[node.func.id](*map(self._argument(node.func.id), args), **options)
        if isinstance(node.func, ast.Attribute):
            name, owner = node.func.attr, node.func.value
            if isinstance(owner, ast.Name) and owner.id in ("np", "pd") and name in FUNCTIONS:
                return FUNCTIONS[name](*map(self._argument(name), args), **options)
            if isinstance(owner, ast.Attribute) and owner.attr == "str":
                owner = owner.value
            value = _lit(self.visit(owner))
            if self.group is not None and name in AGGREGATES:
                return AGGREGATES[name](value, *args, **options)
            if name in METHODS:
                return METHODS[name](value, *args, **options)
        raise ValueError(f"not supported in an expression: {ast.unparse(node)}")

    @staticmethod
    def _argument(name):
        return (lambda v: v) if name == "round" else _lit


def compile_expression(expression: str, constants: dict | None = None, group: Column | None = None) -> Column:
    """The Column of ``expression``; with ``group`` as ``x``, an aggregate."""
    return _lit(_Compiler(constants or {}, group).visit(parse(expression)))
