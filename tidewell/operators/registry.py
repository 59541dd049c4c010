"""Stored models: versions for each entity and target, their life cycle, and predictions by them.

A model is kept as text in a keyed table.  A run learns for the entities that have no
model, an expired one or a poor one, if features and target are correlated enough; it
holds back a fifth of the rows to score by.  A new model takes the place of none or
of an expired one, and of a poor one if it scores higher.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.sources.manifest import KeyedTable
from tidewell.sources.staging import staged

SCHEMA = (
    "name string, entity string, target string, version int, features string, fitted timestamp_ntz, expires timestamp_ntz, "
    "metric string, train_score double, test_score double, payload string"
)
KEYS = ["name", "entity", "target", "version"]


@dataclass(frozen=True)
class LifeCycle:
    """When to learn, and what to keep; the defaults are fixed values."""

    shelf_life_days: float | None = None
    train: bool = True
    stop_improving_at: float = 0.85
    least_accepted: float = -10.0
    least_correlation: float = 0.5
    folds: int = 5


class ModelRegistry:
    """The models at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.table = KeyedTable(spark, path, SCHEMA, KEYS, buckets)

    def versions(self, name: str, target: str) -> DataFrame:
        return self.table.read().where((F.col("name") == name) & (F.col("target") == target))

    def latest(self, name: str, target: str) -> DataFrame:
        """The last version for each entity; retired models are left out."""
        last = Window.partitionBy("entity").orderBy(F.desc("version"))
        return self.versions(name, target).withColumn("_n", F.row_number().over(last)).where("_n = 1 and payload is not null").drop("_n")

    def add(self, models: DataFrame) -> bool:
        """Put in ``models`` (all columns but the version) as next versions."""

        def changes(stored: DataFrame) -> DataFrame:
            last = stored.groupBy(*KEYS[:3]).agg(F.max("version").alias("_last"))
            return models.join(last, KEYS[:3], "left").withColumn("version", F.coalesce(F.col("_last") + 1, F.lit(1))).drop("_last")

        return self.table.update(changes)

    def retire(self, name: str, target: str, entities: list[str] | None = None) -> bool:
        """Entities, by default all, have no model from now on; old versions stay readable."""
        now = self.latest(name, target)
        gone = now if entities is None else now.where(F.col("entity").isin(*entities))
        return self.add(gone.drop("version").withColumn("payload", F.lit(None).cast("string")))


def to_learn(entities: DataFrame, latest: DataFrame, life: LifeCycle, now: datetime) -> DataFrame:
    """entity, why (missing, expired or poor) and the old test score of the entities that need a model."""
    at = F.lit(now).cast("timestamp_ntz")
    why = F.when(F.col("fitted").isNull(), "missing").when(F.col("expires") <= at, "expired").when(F.coalesce(F.col("test_score") < life.stop_improving_at, F.lit(True)), "poor")
    joined = entities.join(latest.select("entity", "fitted", "expires", F.col("test_score")), "entity", "left")
    return joined.select("entity", why.alias("why"), F.col("test_score").alias("old_score")).where(F.col("why").isNotNull() & F.lit(life.train))


def rank_correlation(rows: DataFrame) -> DataFrame:
    """_e and _rho, the largest Spearman correlation of a feature of ``rows`` (_e, _x, _y) with the target."""
    values = rows.select("_e", "_y", F.posexplode("_x").alias("_j", "_v"))

    def ranked(c: str):
        whole = Window.partitionBy("_e", "_j")
        return F.rank().over(whole.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("_e", "_j", c)) - 1) / 2

    ranks = values.select("_e", "_j", ranked("_v").alias("_a"), ranked("_y").alias("_b"))
    return ranks.groupBy("_e", "_j").agg(F.corr("_a", "_b").alias("_rho")).groupBy("_e").agg(F.max(F.nanvl("_rho", F.lit(None).cast("double"))).alias("_rho"))


def r2(scored: DataFrame, name: str) -> DataFrame:
    """_e and the r2 of _p against _y; null where _y has one value or none."""
    mean = F.avg("_y").over(Window.partitionBy("_e"))
    off = scored.where(F.col("_y").isNotNull() & F.col("_p").isNotNull()).withColumn("_m", mean)
    total = F.sum((F.col("_y") - F.col("_m")) ** 2)
    return off.groupBy("_e").agg((1 - F.sum((F.col("_y") - F.col("_p")) ** 2) / F.nullif(total, F.lit(0.0))).alias(name))


def estimate(
    rows: DataFrame, learn: DataFrame, registry: ModelRegistry, name: str, target: str, features: list[str], fit: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame, DataFrame, str], DataFrame],
    life: LifeCycle, now: datetime, prediction: str,
) -> DataFrame:
    """``rows`` (_e, _x and others) without _x, with the prediction by each entity's stored model.

    New models are learned from ``learn`` (_e, _t, _x, _y; no nulls).  ``fit`` makes
    models (_e, payload) of rows with _x and _y, ``score`` values of rows by models.
    Entities without a model get null.
    """
    known = learn.select(F.col("_e").alias("entity")).distinct()
    latest = staged(registry.latest(name, target))
    due = to_learn(known, latest, life, now)
    if life.least_correlation > 0:
        fitting = rank_correlation(learn).where(F.col("_rho") >= life.least_correlation)
        due = due.join(fitting.select(F.col("_e").alias("entity")), "entity", "left_semi")
    due = staged(due)
    if due.take(1):
        mine = staged(learn.join(due.select(F.col("entity").alias("_e")), "_e", "left_semi").withColumn("_fold", F.pmod(F.xxhash64("_e", "_t"), F.lit(life.folds))))
        models = fit(mine.where("_fold <> 0").select("_e", "_x", "_y"))
        scored = staged(score(mine, models, "_p"))
        scores = r2(scored.where("_fold = 0"), "test_score").join(r2(scored.where("_fold <> 0"), "train_score"), "_e", "full").withColumnRenamed("_e", "entity")
        judged = due.join(models.withColumnRenamed("_e", "entity"), "entity").join(scores, "entity", "left")
        good = F.coalesce(F.col("test_score") > life.least_accepted, F.lit(True))
        better = (F.col("why") != "poor") | F.col("old_score").isNull() | F.coalesce(F.col("test_score") > F.col("old_score"), F.lit(False))
        expires = None if life.shelf_life_days is None else now + timedelta(days=life.shelf_life_days)
        registry.add(staged(judged.where(good & better).select(
            F.lit(name).alias("name"), "entity", F.lit(target).alias("target"), F.lit(",".join(features)).alias("features"), F.lit(now).cast("timestamp_ntz").alias("fitted"),
            F.lit(expires).cast("timestamp_ntz").alias("expires"), F.lit("r2").alias("metric"), "train_score", "test_score", "payload",
        )))
        latest = staged(registry.latest(name, target))
    return score(rows, latest.select(F.col("entity").alias("_e"), "payload"), prediction)
