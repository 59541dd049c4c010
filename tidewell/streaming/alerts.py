"""The alerts with memory over streams, by the same step functions as in batch runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.alerts import OccurrenceRule, OccurrenceState, count_occurrences


def occurrence_alerts(stream: DataFrame, entity: str, ts: str, condition, rule: OccurrenceRule, late: str = "10 minutes", state_ttl_s: int = 7 * 86_400) -> DataFrame:
    """entity and time of each alert of a stream of rows with a condition.

    Within a batch rows are put in time order; rows over ``late`` behind are dropped
    by the watermark.  An entity's state is given up after ``state_ttl_s`` of event
    time without rows.
    """
    rows = stream.select(F.col(entity).cast("string").alias("e"), F.col(ts).cast("timestamp").alias("t"), F.coalesce(condition, F.lit(False)).alias("hit")).withWatermark("t", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(batches)).sort_values("t", kind="stable")
        memory = OccurrenceState.load(state.get[0] if state.exists else None)
        times = (frame["t"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        fired = count_occurrences(list(zip(times, frame["hit"].tolist())), rule, memory)
        state.update((memory.dump(),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(times[-1] * 1000)) + state_ttl_s * 1000 + 1)
        yield frame.loc[fired, ["e", "t"]]

    return rows.groupBy("e").applyInPandasWithState(step, "e string, t timestamp", "memory string", "append", GroupStateTimeout.EventTimeTimeout)


def no_data_alerts_stream(stream: DataFrame, entity: str, ts: str, duration_s: float, late: str = "0 seconds", cooldown_s: float | None = None, give_up_s: int = 7 * 86_400) -> DataFrame:
    """entity and time of each alert that data has been missing, as batch runs find them.

    A gap of more than ``duration_s`` alerts at its start + duration and then every
    ``cooldown_s`` (default: the duration) until the next row.  Gaps that are still
    open alert as the watermark passes; an entity without rows for ``give_up_s`` is
    forgotten.  A late row does not take back alerts of the gap that it falls into.
    """
    wait, again = round(duration_s * 1e6), round((cooldown_s or duration_s) * 1e6)
    rows = stream.select(F.col(entity).cast("string").alias("e"), F.col(ts).cast("timestamp").alias("t")).withWatermark("t", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, 0)
        mark, alerts = state.getCurrentWatermarkMs() * 1000, []
        if state.hasTimedOut:
            while last + wait + told * again <= mark:
                alerts.append(last + wait + told * again)
                told += 1
            gone = mark - last > give_up_s * 1_000_000
        else:
            gone = False
            for t in sorted(x for b in batches for x in b["t"].astype("datetime64[us]").astype("int64").tolist()):
                if last is not None and t > last:
                    alerts += range(last + wait + told * again, t, again)
                if last is None or t > last:
                    last, told = t, 0
        if gone:
            state.remove()
        else:
            state.update((last, told))
            state.setTimeoutTimestamp(max((last + wait + told * again) // 1000, state.getCurrentWatermarkMs()) + 1)
        if alerts:
            yield pd.DataFrame({"e": [key[0]] * len(alerts), "t": pd.to_datetime(alerts, unit="us")})

    return rows.groupBy("e").applyInPandasWithState(step, "e string, t timestamp", "last long, told long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_means(stream: DataFrame, entity: str, ts: str, item: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling means per entity, each emitted once its window is past the watermark."""
    rows = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(entity, F.window("_t", window).alias("w")).agg(F.avg(item).alias(f"mean_{item}"), F.count(item).alias("n")).select(entity, F.col("w.start").alias("start"), f"mean_{item}", "n")


