"""Kernel densities by binning: one aggregation into cells, and a convolution over the cells.

A value is shared out to the two cells beside it, by its distance from each.  Cells
are ``1 / PER`` bandwidths wide and only those that hold something are kept, so a
long series costs an aggregation.  Each cell then gives its neighbours within
``REACH`` bandwidths what the Gaussian kernel says.  Sharing out errs by at most
1 / (8 PER ** 2) of a kernel's height, leaving out the rest by exp(-REACH ** 2 / 2).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.catalog import operator
from tidewell.operators.joins import small
from tidewell.sources.staging import staged

PER, REACH = 8, 5
#: The error of a density in kernel heights, 1 / (bandwidth * sqrt(2 pi)).
ERROR = 1 / (8 * PER**2) + math.exp(-(REACH**2) / 2)


def bandwidths(rows: DataFrame) -> DataFrame:
    """_e, _n, the least value _low and Scott's bandwidth _h of ``rows`` (_e, _x); 0 where all values are one."""
    stats = rows.groupBy("_e").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("_sd"))
    return stats.select("_e", "_n", "_low", (F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_h"))


def density_cells(rows: DataFrame, widths: DataFrame) -> DataFrame:
    """_e, the cell _c and the density _d at _low + _c * _h / PER, wherever it is not nothing; ``rows`` have _e and _x, no nulls.

    Cells that hold something are summed where they are and dealt by entity, so that
    what they give their neighbours isn't shuffled.  By Chebyshev's inequality an entity of
    n values fills fewer than 20 * n ** 0.47 cells, so none is large.
    """
    placed = rows.join(small(widths.where("_h > 0")), "_e").withColumn("_u", (F.col("_x") - F.col("_low")) / F.col("_h") * PER)
    cell = F.floor("_u")
    share = F.array(F.struct(cell.alias("c"), (1 + cell - F.col("_u")).alias("w")), F.struct((cell + 1).alias("c"), (F.col("_u") - cell).alias("w")))
    cells = placed.select("_e", F.explode(share).alias("s")).groupBy("_e", F.col("s.c").alias("_c")).agg(F.sum("s.w").alias("_w"))
    near = cells.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_e").select("_e", "_c", "_w", F.explode(F.sequence(F.lit(-PER * REACH), F.lit(PER * REACH))).alias("_k"))
    kernel = F.exp(F.col("_k") * F.col("_k") * F.lit(-0.5 / PER**2))
    summed = near.groupBy("_e", (F.col("_c") + F.col("_k")).alias("_c")).agg(F.sum(F.col("_w") * kernel).alias("_s"))
    return summed.join(small(widths), "_e").select("_e", "_c", (F.col("_s") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("_d"))


def dense_range(rows: DataFrame, share: float) -> DataFrame:
    """_e and the range _from to _to of ``rows`` (_e, _x) in which the density reaches ``share`` of its largest.

    Of several such stretches the range holds all.  It is that of the values where
    they are all one.
    """
    widths = staged(bandwidths(rows))
    cells = density_cells(rows, widths).withColumn("_top", F.max("_d").over(Window.partitionBy("_e")))
    found = cells.where(F.col("_d") >= share * F.col("_top")).groupBy("_e").agg(F.min("_c").alias("_a"), F.max("_c").alias("_b"))
    at = lambda c: F.col("_low") + F.coalesce(F.col(c), F.lit(0)) * F.col("_h") / PER
    return widths.join(found, "_e", "left").select("_e", at("_a").alias("_from"), at("_b").alias("_to"))


def _values(df: DataFrame, ctx, item: str) -> DataFrame:
    value = F.nanvl(F.col(item).cast("double"), F.lit(None).cast("double"))
    return df.select(F.col(ctx.entity).alias("_e"), value.alias("_x")).where("_x is not null and _e is not null")


@operator("RobustThresholdKDE", inputs=("input_item",), outputs=("output_item",))
def robust_threshold_kde(df, ctx, input_item, threshold, output_item):
    """True inside the range of values whose density reaches ``threshold`` of the largest; null for null."""
    ranges = staged(dense_range(_values(df, ctx, input_item), threshold))
    joined = df.join(small(ranges), F.col(ctx.entity) == F.col("_e"), "left")
    return joined.withColumn(output_item, F.col(input_item).between(F.col("_from"), F.col("_to"))).drop("_e", "_from", "_to")


@operator("KDEMaxMin", inputs=("input_item",), outputs=("output_item",))
def kde_max_min(df, ctx, input_item, output_item, threshold=0.01):
    """The range of values whose density reaches ``threshold`` of the largest, as ``least`` and ``most``."""
    ranges = staged(dense_range(_values(df, ctx, input_item), threshold))
    joined = df.join(small(ranges), F.col(ctx.entity) == F.col("_e"), "left")
    return joined.withColumn(output_item, F.struct(F.col("_from").alias("least"), F.col("_to").alias("most"))).drop("_e", "_from", "_to")


def density_at(rows: DataFrame) -> DataFrame:
    """``rows`` (_e, _x and others) with the density ``_p`` of their entity's values at each value, between the two cells beside it.

    0 where all values are one.
    """
    known = rows.select("_e", "_x").where("_x is not null and _e is not null")
    widths = staged(bandwidths(known))
    cells = staged(density_cells(known, widths))
    placed = rows.join(small(widths), "_e", "left").withColumn("_u", (F.col("_x") - F.col("_low")) / F.nullif(F.col("_h"), F.lit(0.0)) * PER)
    out = placed.withColumn("_c", F.floor("_u"))
    left, right = (cells.select(F.col("_e"), (F.col("_c") - i).alias("_c"), F.col("_d").alias(f"_d{i}")) for i in (0, 1))
    met = out.join(left, ["_e", "_c"], "left").join(right, ["_e", "_c"], "left")
    part = F.col("_u") - F.col("_c")
    found = F.coalesce(F.col("_d0"), F.lit(0.0)) * (1 - part) + F.coalesce(F.col("_d1"), F.lit(0.0)) * part
    return met.withColumn("_p", F.when(F.col("_x").isNotNull() & F.col("_n").isNotNull(), F.coalesce(found, F.lit(0.0)))).drop("_u", "_c", "_d0", "_d1", "_n", "_low", "_h")
