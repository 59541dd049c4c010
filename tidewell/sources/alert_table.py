"""The table of alerts: written, resolved and reactivated by each run.

A run computes alerts for the entities and the stretch of time of its rows.  Within
those, computed alerts that the table lacks are new, stored ones no longer computed
become Resolved, and resolved ones that are computed again get their first status
back.  Alerts that a user has changed stay as they are.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog import Context, operator
from tidewell.operators.alerts import alert_changes, computed_alerts
from tidewell.sources.manifest import KeyedTable

KEYS = ["entity_type_id", "data_item_name", "entity_id", "timestamp"]
SCHEMA = "entity_type_id string, data_item_name string, entity_id string, timestamp timestamp_ntz, domain_status string, last_updated_by string, created_ts timestamp_ntz, updated_ts timestamp_ntz"
#: The statuses of the table.
NEW, RESOLVED = "New", "Resolved"
SYSTEM = "SYSTEM"


def alert_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, path, SCHEMA, KEYS, buckets)


def changed_alerts(stored: DataFrame, df: DataFrame, ctx: Context, alert_names: list[str], entity_type: str, at: datetime, statuses: dict[str, str] | None = None) -> DataFrame:
    """The rows of the table that a run over ``df`` adds or changes.

    ``statuses`` gives the first status of an alert, New by default.  A frame without
    rows changes nothing.
    """
    text = lambda c: F.col(c).cast("string")
    seen = df.select(text(ctx.entity).alias("entity_id"), F.col(ctx.timestamp).cast("timestamp_ntz").alias("timestamp"))
    span = seen.agg(F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to"))
    mine = stored.where((F.col("entity_type_id") == entity_type) & F.col("data_item_name").isin(*alert_names))
    mine = mine.join(F.broadcast(span), (F.col("timestamp") >= F.col("_from")) & (F.col("timestamp") <= F.col("_to"))).drop("_from", "_to")
    mine = mine.join(seen.select("entity_id").distinct(), "entity_id", "left_semi")
    computed = computed_alerts(df, ctx, alert_names, entity_type).select("entity_type_id", "data_item_name", text("entity_id").alias("entity_id"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))
    changes = alert_changes(computed, mine, KEYS, system=SYSTEM)
    first = F.lit(NEW)
    for name, status in (statuses or {}).items():
        first = F.when(F.col("data_item_name") == name, status).otherwise(first)
    created = mine.select(*KEYS, F.col("created_ts").alias("_created"))
    return changes.join(created, KEYS, "left").select(
        *KEYS, F.when(F.col("change") == "stale", RESOLVED).otherwise(first).alias("domain_status"), F.lit(SYSTEM).alias("last_updated_by"),
        F.coalesce("_created", F.lit(at).cast("timestamp_ntz")).alias("created_ts"), F.lit(at).cast("timestamp_ntz").alias("updated_ts"),
    )


def produce_alerts(table: KeyedTable, df: DataFrame, ctx: Context, alert_names: list[str], entity_type: str, at: datetime, statuses: dict[str, str] | None = None, writer: str | None = None, batch: int | None = None) -> bool:
    """Bring the table up to a run's rows; whether it changed.  The same batch again, or the same rows, change nothing."""
    return table.update(lambda stored: changed_alerts(stored, df, ctx, alert_names, entity_type, at, statuses), writer, batch)


@operator("ProduceAlerts", inputs=("alerts",), kind="sink")
def produce_alerts_step(df, ctx, alerts, path, entity_type, statuses=None):
    produce_alerts(alert_table(df.sparkSession, path), df, ctx, list(alerts), entity_type, ctx.launch or datetime.now(), statuses)
    return df


def alert_sink(path: str, ctx: Context, alert_names: list[str], entity_type: str, writer: str, statuses: dict[str, str] | None = None):
    """For ``writeStream.foreachBatch``: each batch goes into the table at ``path`` once, also after a restart.

    The stream's rows hold the alert columns; a batch resolves stored alerts of its
    entities within its own stretch of time only.
    """

    def run(df: DataFrame, batch: int) -> None:
        produce_alerts(alert_table(df.sparkSession, path), df, ctx, alert_names, entity_type, datetime.now(), statuses, writer, batch)

    return run


def touch(table: KeyedTable, rows: DataFrame, user: str, at: datetime) -> bool:
    """A user's change: ``rows`` hold the keys and the status they set; runs leave these alerts alone from now on."""
    return table.update(lambda stored: stored.drop("domain_status", "last_updated_by", "updated_ts").join(rows.select(*KEYS, "domain_status"), KEYS).withColumns({"last_updated_by": F.lit(user), "updated_ts": F.lit(at).cast("timestamp_ntz")}))
