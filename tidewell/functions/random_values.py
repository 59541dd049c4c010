"""Seeded random columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.catalog import listed, operator
from tidewell.functions.scalars import adjust_probabilities


def choice(values: list, probabilities: list[float] | None, seed: int) -> Column:
    """One of ``values`` by ``probabilities`` (equal where not given); one draw a row."""
    total, edges = 0.0, []
    for value, share in zip(values, adjust_probabilities(list(probabilities or [1.0] * len(values)))):
        total += share
        edges.append((total, value))
    return F.transform(F.array(F.rand(seed)), lambda draw: _by_edge(edges, draw)).getItem(0)


def _by_edge(edges, draw: Column) -> Column:
    out = F.lit(edges[-1][1])
    for edge, value in reversed(edges[:-1]):
        out = F.when(draw < edge, F.lit(value)).otherwise(out)
    return out


@operator("RandomNoise", inputs=("input_items",), outputs=("output_items",))
def random_noise(df, ctx, input_items, standard_deviation, output_items, seed=1):
    return df.withColumns({n: F.col(c) + F.randn(seed + i) * standard_deviation for i, (c, n) in enumerate(zip(listed(input_items), listed(output_items)))})


@operator("RandomUniform", outputs=("output_item",))
def random_uniform(df, ctx, min_value, max_value, output_item="output_item", seed=1):
    return df.withColumn(output_item, F.rand(seed) * (max_value - min_value) + min_value)


@operator("RandomNormal", outputs=("output_item",))
def random_normal(df, ctx, mean, standard_deviation, output_item="output_item", seed=1):
    return df.withColumn(output_item, F.randn(seed) * standard_deviation + mean)


@operator("RandomNull", inputs=("input_items",), outputs=("output_items",))
def random_null(df, ctx, input_items, output_items, seed=1):
    return df.withColumns({n: F.when(F.rand(seed + i) >= 0.5, F.col(c)) for i, (c, n) in enumerate(zip(listed(input_items), listed(output_items)))})


@operator("RandomChoiceString", outputs=("output_item",))
def random_choice_string(df, ctx, domain_of_values, probabilities=None, output_item="output_item", seed=1):
    return df.withColumn(output_item, choice(listed(domain_of_values), probabilities, seed))


@operator("RandomDiscreteNumeric", outputs=("output_item",))
def random_discrete_numeric(df, ctx, discrete_values, probabilities=None, output_item="output_item", seed=1):
    return df.withColumn(output_item, choice([float(v) for v in discrete_values], probabilities, seed))
