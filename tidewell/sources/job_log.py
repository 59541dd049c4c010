"""The log of runs: events that are only ever appended.

A run's state is that of its last event, so an event costs one small file and nothing
is rewritten.  A run that died without a word still counts as running; the next start
of its job calls it abandoned and can go on from the stretch it finished last.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.manifest import Folder

SCHEMA = (
    "run_id string, number int, object_type string, object_name string, schedule string, execution_date timestamp_ntz, status string, at timestamp_ntz, "
    "previous_execution_date timestamp_ntz, next_execution_date timestamp_ntz, done_until timestamp_ntz, startup_log string, execution_log string, trace string"
)
RUNNING, COMPLETE, ABORTED, ABANDONED = "running", "complete", "aborted", "abandoned"


class Run:
    """One run's part of the log."""

    def __init__(self, log: JobLog, **fixed):
        self.log, self.fixed, self.number = log, fixed, 0

    def tell(self, status: str, **values) -> None:
        self.log.append([self.fixed | {"status": status, "number": self.number} | values])
        self.number += 1


class JobLog:
    """The log at ``path``, for payloads of one type."""

    def __init__(self, spark: SparkSession, path: str, object_type: str = "EntityType", now=datetime.now):
        self.spark, self.path, self.object_type, self.now = spark, path, object_type, now
        self.schema = spark.createDataFrame([], SCHEMA).schema

    def append(self, events: list[dict]) -> None:
        rows = [tuple({"at": self.now(), **e}.get(n) for n in self.schema.names) for e in events]
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        written = any(n.endswith(".parquet") for n in Folder(self.spark, self.path).names())
        return self.spark.read.schema(self.schema).parquet(self.path) if written else self.spark.createDataFrame([], self.schema)

    def runs(self) -> DataFrame:
        """One row a run: its last status, and of other columns the last value that was told."""
        fixed = ["run_id", "object_type", "object_name", "schedule", "execution_date"]
        rest = [n for n in self.schema.names if n not in (*fixed, "number")]
        last = lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col("number"))).alias(n)
        return self.events().groupBy(*fixed).agg(*(last(n) for n in rest)).select(*(n for n in self.schema.names if n != "number"))

    def _of(self, name: str, schedule: str, status: str) -> DataFrame:
        return self.runs().where((F.col("object_type") == self.object_type) & (F.col("object_name") == name) & (F.col("schedule") == schedule) & (F.col("status") == status))

    def start(self, name: str, schedule: str, execution_date: datetime, **values) -> Run:
        run = Run(self, run_id=uuid.uuid4().hex, object_type=self.object_type, object_name=name, schedule=schedule, execution_date=execution_date)
        run.tell(RUNNING, **values)
        return run

    def clear_old_running(self, name: str, schedule: str) -> int:
        """Call running runs of a job abandoned; how many there were."""
        found = self._of(name, schedule, RUNNING).select("run_id", "object_type", "object_name", "schedule", "execution_date").collect()
        if found:
            numbers = {r["run_id"]: r["n"] for r in self.events().groupBy("run_id").agg(F.max("number").alias("n")).where(F.col("run_id").isin(*(r["run_id"] for r in found))).collect()}
            self.append([r.asDict() | {"status": ABANDONED, "number": numbers[r["run_id"]] + 1} for r in found])
        return len(found)

    def last_execution_date(self, name: str, schedule: str) -> datetime | None:
        return self._of(name, schedule, COMPLETE).agg(F.max("execution_date")).first()[0]

    def done_until(self, name: str, schedule: str) -> datetime | None:
        """How far runs that did not end well have come since the last one that did."""
        since = self.last_execution_date(name, schedule)
        cut = self._of(name, schedule, ABANDONED).unionByName(self._of(name, schedule, ABORTED))
        return (cut if since is None else cut.where(F.col("execution_date") > F.lit(since))).agg(F.max("done_until")).first()[0]


class NoJobLog:
    """Keeps nothing: every schedule is due, and no run is resumed."""

    class _Run:
        def tell(self, status: str, **values) -> None:
            pass

    def start(self, *fixed, **values) -> _Run:
        return self._Run()

    def clear_old_running(self, name: str, schedule: str) -> int:
        return 0

    def last_execution_date(self, name: str, schedule: str) -> None:
        return None

    def done_until(self, name: str, schedule: str) -> None:
        return None
