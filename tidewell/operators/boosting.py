"""Gradient boosted trees, one model for each entity, all entities in one plan.

Features are cut into bins once.  A level of a tree is an aggregation of residuals by
entity, node, feature and bin, which combines before its shuffle, so an entity may
have any number of rows; a window over the bins gives each node its best split, and
the splits go back to the rows by a join.  Residuals are summed as whole numbers, in
fractions of an entity's largest deviation, so reruns make the same trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.joins import small
from tidewell.sources.staging import staged

#: Parts of the largest deviation that a residual is rounded to.
UNIT = 1 << 30
#: Rows of one entity that are scored in one task.
SCORED = 100_000


@dataclass(frozen=True)
class Boosting:
    trees: int = 20
    depth: int = 5
    rate: float = 0.2
    bins: int = 64
    least_rows: int = 20


def _binned(rows: DataFrame, options: Boosting) -> tuple[DataFrame, DataFrame]:
    """Rows (_e, _y, _bins, _f, _scale), and per entity _base, _scale and the edges of the bins of each feature."""
    values = rows.select("_e", F.posexplode("_x").alias("_j", "_v"))
    cuts = [j / options.bins for j in range(1, options.bins)]
    edges = values.groupBy("_e", "_j").agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", cuts, 10_000))).alias("_c"))
    edges = edges.groupBy("_e").agg(F.array_sort(F.collect_list(F.struct("_j", "_c"))).alias("_edges")).select("_e", F.col("_edges._c").alias("_edges"))
    ends = rows.groupBy("_e").agg(F.avg("_y").alias("_base"), F.min("_y").alias("_low"), F.max("_y").alias("_high"))
    spread = F.greatest(F.col("_high") - F.col("_base"), F.col("_base") - F.col("_low"))
    entities = staged(edges.join(ends, "_e").select("_e", "_edges", "_base", F.when(spread > 0, spread).otherwise(1.0).alias("_scale")))
    bins = F.expr("transform(_x, (v, i) -> size(filter(_edges[i], c -> c < v)))")
    return staged(rows.join(small(entities), "_e").select("_e", "_y", bins.alias("_bins"), F.col("_base").alias("_f"), "_scale")), entities


def _best_splits(at: DataFrame, least: int) -> DataFrame:
    """The split of each node (_e, _node) that gains most: feature _sf, after bin _sb; of equal gains the first feature and bin."""
    values = at.where("_node > 0").select("_e", "_node", "_r", F.posexplode("_bins").alias("_j", "_b"))
    sums = values.groupBy("_e", "_node", "_j", "_b").agg(F.sum("_r").alias("_g"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_e", "_node", "_j")
    below = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sums.select(
        "_e", "_node", "_j", "_b", F.sum("_g").over(below).cast("double").alias("_gl"), F.sum("_n").over(below).cast("double").alias("_nl"),
        F.sum("_g").over(whole).cast("double").alias("_ga"), F.sum("_n").over(whole).cast("double").alias("_na"),
    ).where((F.col("_nl") >= least) & (F.col("_na") - F.col("_nl") >= least))
    before = F.col("_ga") * F.col("_ga") / F.col("_na")
    rest, kept = F.col("_ga") - F.col("_gl"), F.col("_na") - F.col("_nl")
    gain = F.col("_gl") * F.col("_gl") / F.col("_nl") + rest * rest / kept - before
    found = cut.withColumn("_gain", gain).where(F.col("_gain") > before * 1e-10 + 1.0)  # less is rounding
    best = found.groupBy("_e", "_node").agg(F.max(F.struct("_gain", (-F.col("_j")).alias("j"), (-F.col("_b")).alias("b"))).alias("_s"))
    return best.select("_e", "_node", (-F.col("_s.j")).alias("_sf"), (-F.col("_s.b")).alias("_sb"))


def fit_boosting(rows: DataFrame, options: Boosting) -> DataFrame:
    """A model, as JSON text ``payload``, for each entity of ``rows`` (_e, _x, _y; no nulls): _e, payload."""
    state, entities = _binned(rows, options)
    nodes = None
    for tree in range(options.trees):
        residual = F.round((F.col("_y") - F.col("_f")) / F.col("_scale") * UNIT).cast("long")
        at = state.withColumns({"_r": residual, "_node": F.lit(1)})
        parts = []
        for _ in range(options.depth):
            splits = staged(_best_splits(at, options.least_rows))
            parts.append(splits.select("_e", F.lit(tree).alias("tree"), F.col("_node").alias("node"), F.col("_sf").alias("feature"), F.col("_sb").alias("bin"), F.lit(None).cast("double").alias("value")))
            right = F.element_at("_bins", F.col("_sf") + 1) > F.col("_sb")
            moved = F.when(F.col("_sf").isNull(), -F.abs("_node")).otherwise(2 * F.col("_node") + right.cast("int"))  # a node below 0 is a leaf
            at = at.join(small(splits), ["_e", "_node"], "left").withColumn("_node", moved).drop("_sf", "_sb")
        mean = F.sum("_r").cast("double") / F.count(F.lit(1)) / UNIT
        leaves = staged(at.groupBy("_e", "_node").agg((mean * F.first("_scale") * options.rate).alias("_value")))
        state = staged(at.join(small(leaves), ["_e", "_node"]).select("_e", "_y", "_bins", (F.col("_f") + F.col("_value")).alias("_f"), "_scale"))
        none = F.lit(None).cast("int")
        parts.append(leaves.select("_e", F.lit(tree).alias("tree"), F.abs("_node").alias("node"), none.alias("feature"), none.alias("bin"), F.col("_value").alias("value")))
        for part in parts:
            nodes = part if nodes is None else nodes.unionByName(part)
    empty = entities.select("_e", F.lit(None).cast("string").alias("nodes")).limit(0)
    listed = empty if nodes is None else nodes.groupBy("_e").agg(F.to_json(F.sort_array(F.collect_list(F.struct("tree", "node", "feature", "bin", "value")))).alias("nodes"))
    joined = entities.join(listed, "_e", "left")
    return staged(joined.select("_e", F.to_json(F.struct(F.col("_base").alias("base"), F.col("_edges").alias("edges"), F.lit(options.trees).alias("trees"), F.lit(options.depth).alias("depth"), F.col("nodes"))).alias("payload")))


def evaluate(payload: str, x: np.ndarray) -> np.ndarray:
    """A model's values for the rows of ``x``."""
    model = json.loads(payload)
    size = 1 << (model["depth"] + 1)
    feature, threshold, value = np.full((model["trees"], size), -1), np.zeros((model["trees"], size)), np.zeros((model["trees"], size))
    for n in json.loads(model.get("nodes") or "[]"):
        at = n["tree"], n["node"]
        if "value" in n:
            value[at] = n["value"]
        else:
            feature[at], threshold[at] = n["feature"], model["edges"][n["feature"]][n["bin"]]
    out, every = np.full(len(x), model["base"]), np.arange(len(x))
    for tree in range(model["trees"]):
        node = np.ones(len(x), int)
        for _ in range(model["depth"]):
            f = feature[tree, node]
            node = np.where(f < 0, node, 2 * node + (x[every, np.maximum(f, 0)] > threshold[tree, node]))
        out += value[tree, node]
    return out


def _scorer(name: str, columns: list[str]):
    """Batches sorted by entity and part, in which a row with the model comes before those that it scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, payload = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(c) for c in ("_e", "_part")]
            same = np.logical_and.reduce([pc.fill_null(pc.equal(k[1:], k[:-1]), False).to_numpy(zero_copy_only=False) for k in keys])
            edges = np.concatenate(([0], np.nonzero(~same)[0] + 1, [n])).tolist()
            models, lists = batch.column("_payload"), batch.column("_x")
            row = models.is_null().to_numpy(zero_copy_only=False)
            out, known = np.zeros(n), np.zeros(n, bool)
            for a, b in zip(edges[:-1], edges[1:]):
                key = keys[0][a].as_py(), keys[1][a].as_py()
                if key != last:
                    last, payload = key, None
                if not row[a]:
                    payload, a = models[a].as_py(), a + 1
                if payload is not None and b > a:
                    x = pc.list_flatten(lists.slice(a, b - a)).to_numpy(zero_copy_only=False).astype(float).reshape(b - a, -1)
                    out[a:b], known[a:b] = evaluate(payload, x), True
            scored = batch.select(columns).append_column(name, pa.array(out, pa.float64(), mask=~known))
            yield scored.filter(pa.array(row))

    return run


def score_boosting(rows: DataFrame, models: DataFrame, name: str) -> DataFrame:
    """``rows`` (_e, _x and others) without _x, with the value ``name`` of their entity's model (_e, payload), null without one.

    An entity's rows are dealt to several tasks if they are many, each with the model.
    """
    columns = [c for c in rows.columns if c != "_x"]
    parts = rows.groupBy("_e").agg(F.ceil(F.count(F.lit(1)) / F.lit(SCORED)).cast("int").alias("_parts"))
    given = models.select(F.col("_e").alias("_own"), "payload").select(F.col("_own").alias("_e"), "payload").join(parts, "_e").select("_e", "payload", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    dealt = rows.join(small(parts), "_e", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_x"), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    both = dealt.withColumn("_payload", F.lit(None).cast("string")).unionByName(given.where("payload is not null").select("_e", "_part", F.col("payload").alias("_payload")), allowMissingColumns=True)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(tasks, "_e", "_part").sortWithinPartitions("_e", "_part", F.col("_payload").isNull())
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in columns), T.StructField(name, T.DoubleType())])
    return ordered.mapInArrow(_scorer(name, columns), schema)
