"""Mixing sources to target weights, by DataFrame operations alone.

Token counts are summed per source before anything is shuffled, so a source that
holds a third of all rows costs one row per task.  Each source gets a repetition
rate; a document is taken floor(rate) times and once more where a hash of its key
and the seed, read as a number in [0, 1), is below the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, cut

SMALL_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Targets of each source from (source, source_size).

    Sources in code point order, null last, take the weights in turn.  They share
    the sum of all sizes by weight; a target stops at ``cap`` times its source's
    size and the excess is shared again by weight until none is above.  That fixed
    point fills sources in order of cap * size / weight: with the first k of them
    full, the others' level is what is left over their summed weight, and k is the
    first count at which the next source is not above its cap.
    Returns source, source_size, weight, target, rate (0 where the size is 0).
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    level = (F.col("total") - F.col("full_before")) / F.col("weight_left")
    leveled = (
        weighted.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum(F.col("source_size") * cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stops", level * F.col("weight") <= F.col("source_size") * cap)
        # the level at which the first source is not above its cap
        .withColumn("full", F.min(F.when(F.col("stops"), F.col("full_before"))).over(everything))
        .withColumn("left", F.max(F.when(F.col("stops"), F.col("weight_left"))).over(everything))
        .withColumn("target", F.when((F.col("full_before") < F.col("full")) | F.col("full").isNull(), F.col("source_size") * cap).otherwise((F.col("total") - F.col("full")) * F.col("weight") / F.col("left")))
    )
    target = F.least(F.col("target"), F.col("source_size") * cap)
    return leveled.select(
        "source", "source_size", "weight", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key and the seed: the first 13 hex digits of an MD5."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rate: Column, key: Column, seed: int) -> Column:
    return (F.floor(rate) + (unit_hash(key, seed) < rate - F.floor(rate)).cast("int")).cast("long")


def _planned(
    docs: DataFrame, key: str, text: str, source: str, weights: Sequence[float], cap: float, seed: int, whole: Sequence[Column] = (),
) -> DataFrame:
    """key, size, source_size, target, copies and taken of each row, beside the columns ``whole``."""
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("of"), word_count(F.col(text)).alias("size"), *whole)
    if not whole:
        sized = cut(sized)
    totals = cut(sized.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("source_size")))
    targets = source_targets(totals, weights, cap)
    if totals.count() <= SMALL_ROWS:
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col("of").eqNullSafe(F.col("source")))
    planned = joined.withColumn("copies", copies(F.col("rate"), F.col("key"), seed))
    return planned.withColumn("taken", F.col("size") * F.col("copies"))


def mix_plan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 42,
) -> DataFrame:
    """How often each document is taken: key, size, source_size, target, copies, taken.

    Size is the number of words; null and empty texts have size 0 and are taken by
    their source's rate like others (0 times where the source has no words).  Null
    is a source of its own, last in order.  Repeated rows of a key, null keys
    included, get the same number of copies.  Other columns of ``docs``, whatever
    their names, are ignored.
    """
    planned = _planned(docs, key, text, source, weights, cap, seed)
    return planned.select(F.col("key").alias(key), "size", "source_size", "target", "copies", "taken")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 42,
) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as the plan takes it, columns unchanged, of any names."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    planned = _planned(docs, key, text, source, weights, cap, seed, [whole])
    repeated = planned.select("whole", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*(F.col("whole")[c].alias(c) for c in docs.columns))
