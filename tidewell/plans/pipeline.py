"""Entity types and their jobs: ordering of steps, grains, schedules, chunks and the job log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.catalog import Context, Step
from tidewell.functions.scalars import complete_backtrack
from tidewell.functions.transforms import TYPES, check_types, drop_null, schema_changes
from tidewell.operators.aggregate import Aggregate, Granularity, aggregate
from tidewell.operators.alerts import computed_alerts
from tidewell.sources.job_log import JobLog, NoJobLog
from tidewell.sources.tables import scan, to_long


@dataclass
class EntityType:
    """The binding of a source table to keys, declared items, steps and aggregates."""

    name: str
    source: DataFrame
    entity: str = "entity_id"
    timestamp: str = "ts"
    items: dict[str, str] = field(default_factory=dict)
    dimension: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    constants: dict = field(default_factory=dict)
    steps: list[Step] = field(default_factory=list)
    aggregates: dict[Granularity, list[Aggregate]] = field(default_factory=dict)
    alerts: list[str] = field(default_factory=list)
    settings: dict = field(default_factory=dict)

    def context(self, start: datetime | None = None, end: datetime | None = None) -> Context:
        return Context(self.entity, self.timestamp, dict(self.constants), dict(self.tables), start, end, settings=dict(self.settings))

    def get_data(self, start=None, end=None, entities: list | None = None, columns: list[str] | None = None) -> DataFrame:
        """The source in a window, with the dimension's attributes."""
        df = scan(self.source, timestamp_col=self.timestamp, start_ts=start, end_ts=end, entities=entities, dimension=self.dimension, deviceid_col=self.entity)
        return df.select(self.entity, self.timestamp, *(c for c in columns if c not in (self.entity, self.timestamp))) if columns else df

    def unmatched_members(self) -> DataFrame:
        """Entities of the source that the dimension lacks."""
        seen = self.source.select(self.entity).distinct()
        return seen if self.dimension is None else seen.join(self.dimension, self.entity, "left_anti")


class PlanError(ValueError):
    """Steps that can never run, by their missing inputs."""


#: The order of kinds within one level of the plan.
KINDS = ("settings", "preload", "source", "filter", "transformer", "alert", "sink")


def ordered(steps: list[Step], available: set[str]) -> list[Step]:
    """Steps after those that write what they read; kinds in KINDS order, then as listed.

    Filters and sources of one round run before transformers, so that rows are
    settled first.
    """
    left, have, out = list(steps), set(available), []
    while left:
        ready = [s for s in left if s.inputs <= have or s.operator.kind in ("settings", "preload")]
        if not ready:
            missing = {repr(s): sorted(s.inputs - have) for s in left}
            raise PlanError(f"inputs that nothing provides: {missing}")
        least = min(KINDS.index(s.operator.kind) for s in ready)
        now = [s for s in ready if KINDS.index(s.operator.kind) == least]
        out += now
        left = [s for s in left if s not in now]
        for s in now:
            have |= set(s.outputs)
    return out


def needed(steps: list[Step], targets: set[str]) -> list[Step]:
    """The steps that the targets depend on; steps without outputs and row filters always stay."""
    want, keep = set(targets), set()
    changed = True
    while changed:
        changed = False
        for i, s in enumerate(steps):
            if i not in keep and (not s.outputs or s.operator.kind in ("filter", "source", "sink", "settings") or set(s.outputs) & want):
                keep.add(i)
                want |= s.inputs
                changed = True
    return [s for i, s in enumerate(steps) if i in keep]


@dataclass
class Result:
    """A run's frames; all are lazy plans over the source."""

    rows: DataFrame
    grains: dict[str, DataFrame]
    alerts: DataFrame | None
    derived: DataFrame
    messages: list[str]


class CalcPipeline:
    """Runs an entity type's steps over a frame and aggregates to its grains."""

    def __init__(self, entity_type: EntityType, drop_null_rows: bool = True):
        self.type, self.drop_null_rows = entity_type, drop_null_rows

    def rows(self, df: DataFrame, ctx: Context, targets: set[str] | None = None) -> tuple[DataFrame, list[str]]:
        if self.drop_null_rows:
            df = drop_null(df, ctx, exclude_cols=self.type.settings.get("drop_null_exclude"))
        steps = self.type.steps if targets is None else needed(self.type.steps, targets)
        messages = []
        for step in ordered(steps, set(df.columns) | set(ctx.constants)):
            before = df
            df = step.apply(df, ctx)
            messages += [f"{step.operator.name}: {m}" for m in schema_changes(before, df)]
        declared = {n: k for n, k in self.type.items.items() if n in df.columns and k in TYPES}
        return check_types(df, declared) if declared else df, messages

    def execute(self, df: DataFrame | None = None, start: datetime | None = None, end: datetime | None = None, offset: timedelta = timedelta(0)) -> Result:
        ctx = self.type.context(start, end)
        source = self.type.get_data(start, end) if df is None else df
        rows, messages = self.rows(source, ctx)
        grains = {g.name: aggregate(rows, ctx, g, items, offset) for g, items in self.type.aggregates.items()}
        alerts = computed_alerts(rows, ctx, self.type.alerts, self.type.name) if self.type.alerts else None
        made = [c for s in self.type.steps for c in s.outputs if c in rows.columns]
        derived = to_long(rows, [ctx.entity, ctx.timestamp], made) if made else None
        return Result(rows, grains, alerts, derived, messages)


# schedules


@dataclass
class Schedule:
    """How often a job runs, and how far back it reads; both as counts of units."""

    every: timedelta
    start_hour: int = 0
    start_minute: int = 0
    backtrack: dict[str, int] | None = None


def window_start(execute: datetime, backtrack: dict[str, int] | None, checkpoint: datetime | None = None) -> datetime | None:
    """Where a run starts to read: the checkpoint, or the execution less the backtrack."""
    if checkpoint is not None:
        return checkpoint
    if not backtrack:
        return None
    full = complete_backtrack(backtrack)
    back = timedelta(**{k: v for k, v in full.items() if k in ("weeks", "days", "hours", "minutes", "seconds")})
    months = full.get("months", 0) + 12 * full.get("years", 0)
    at = execute - back
    if months:
        total = at.year * 12 + at.month - 1 - months
        at = at.replace(year=total // 12, month=total % 12 + 1, day=min(at.day, 28))
    fields = {k: full[k] for k in ("month", "day", "hour", "minute", "second") if k in full}
    return at.replace(microsecond=0, **fields) if fields else at


def due(schedules: dict[str, Schedule], execute: datetime, last: dict[str, datetime | None]) -> list[str]:
    """Schedules whose time has come, shortest first; a due one subsumes shorter ones' runs."""
    found = []
    for name, s in sorted(schedules.items(), key=lambda x: x[1].every):
        anchor = execute.replace(hour=s.start_hour, minute=s.start_minute, second=0, microsecond=0)
        anchor -= timedelta(days=1) if anchor > execute else timedelta(0)
        slot = anchor + (execute - anchor) // s.every * s.every
        if last.get(name) is None or last[name] < slot:
            found.append(name)
    return found


def chunks(start: datetime, end: datetime, size: timedelta = timedelta(days=7)) -> list[tuple[datetime, datetime]]:
    """Consecutive stretches of [start, end) of ``size`` at most."""
    out = []
    while start < end:
        stop = min(start + size, end)
        out.append((start, stop))
        start = stop
    return out


@dataclass
class JobController:
    """Runs due schedules of an entity type and logs each run.

    A run is one lazy plan over its window; it is cut into chunks only on request,
    since Spark already reads and spills by partition.  Each chunk that the sink has
    taken is logged, and a run that follows one that died goes on after its last
    chunk.  Runs of the same job that still count as running are abandoned first.
    """

    entity_type: EntityType
    schedules: dict[str, Schedule]
    log: JobLog | NoJobLog = field(default_factory=NoJobLog)

    def last_runs(self) -> dict[str, datetime | None]:
        return {n: self.log.last_execution_date(self.entity_type.name, n) for n in self.schedules}

    def execute(self, at: datetime, sink: Callable[[str, Result], None], chunk: timedelta | None = None) -> list[str]:
        ran, last = [], self.last_runs()
        for name in due(self.schedules, at, last):
            schedule, mine = self.schedules[name], (self.entity_type.name, name)
            self.log.clear_old_running(*mine)
            start, done = window_start(at, schedule.backtrack), self.log.done_until(*mine)
            if chunk and done is not None and start is not None and start < done < at:
                start = done
            run = self.log.start(*mine, at, previous_execution_date=last[name])
            try:
                for a, b in chunks(start, at, chunk) if chunk and start else [(start, at)]:
                    sink(name, CalcPipeline(self.entity_type).execute(start=a, end=b))
                    run.tell("running", done_until=b)
                run.tell("complete", next_execution_date=at + schedule.every)
            except Exception as e:
                run.tell("aborted", execution_log=str(e)[:2000])
                raise
            ran.append(name)
        return ran
