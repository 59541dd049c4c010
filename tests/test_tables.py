"""Keyed tables, the alert table, the job log and the controller: updates, conflicts, crashes and restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.catalog import Context, Step
from tidewell.plans.pipeline import EntityType, JobController, Schedule
from tidewell.sources import alert_table as A
from tidewell.sources.job_log import JobLog, NoJobLog
from tidewell.sources.manifest import Conflict, KeyedTable

T0 = datetime(2024, 1, 1)
CTX = Context("e", "t")


def hour(n):
    return T0 + timedelta(hours=n)


def keyed(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "table"), "k string, v int", ["k"], buckets=4)


def put(table, rows, *batch):
    return table.update(lambda _: table.spark.createDataFrame(rows, "k string, v int"), *batch)


def held(table, version=None):
    return {r["k"]: r["v"] for r in table.read(version).collect()}


def test_updates_replace_rows_of_equal_keys(spark, tmp_path):
    table = keyed(spark, tmp_path)
    assert held(table) == {}
    assert put(table, [(f"k{i}", i) for i in range(50)])
    assert put(table, [("k3", 33), (None, 0), ("new", 1), ("new", 2)])
    want = {f"k{i}": i for i in range(50)} | {"k3": 33, None: 0, "new": 2}
    assert held(table) == want and table.read().count() == len(want)
    assert held(table, 1) == {f"k{i}": i for i in range(50)}
    assert not put(table, [])
    assert table.manifest().version == 2


def test_a_batch_goes_in_once(spark, tmp_path):
    table = keyed(spark, tmp_path)
    assert put(table, [("a", 1)], "stream", 0)
    assert not put(table, [("a", 9)], "stream", 0)
    assert put(table, [("a", 2)], "stream", 1)
    assert put(table, [], "stream", 2)
    assert put(table, [("b", 3)], "other", 0)
    assert held(table) == {"a": 2, "b": 3}


def test_a_writer_that_comes_second_starts_over(spark, tmp_path):
    table, times = keyed(spark, tmp_path), []

    def changes(now):
        if not times:
            put(keyed(spark, tmp_path), [("a", 5)])
        times.append(1)
        return now.selectExpr("k", "v + 1 as v").unionByName(spark.createDataFrame([("b", 1)], "k string, v int"))

    assert table.update(changes)
    assert held(table) == {"a": 6, "b": 1} and len(times) == 2
    with pytest.raises(Conflict):
        table.folder.publish("manifest-000000000001.json", "{}")
    assert not [n for n in table.folder.names() if n.startswith(".draft")]


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    table = keyed(spark, tmp_path)
    put(table, [("a", 1)])
    with monkeypatch.context() as m:
        m.setattr(table.folder, "publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            put(table, [("a", 2)])
    assert held(table) == {"a": 1}
    assert put(table, [("a", 3)]) and held(table) == {"a": 3}
    assert table.clean(keep=1) >= 2 and held(table) == {"a": 3}


# alerts


def frame(spark, rows):
    return spark.createDataFrame(rows, "e string, t timestamp_ntz, hot boolean, cold boolean")


def statuses(table):
    return {(r["data_item_name"], r["entity_id"], r["timestamp"]): (r["domain_status"], r["last_updated_by"]) for r in table.read().collect()}


def test_alerts_are_written_resolved_and_reactivated(spark, tmp_path):
    table = A.alert_table(spark, str(tmp_path / "alerts"), 4)
    run = lambda rows, at: A.produce_alerts(table, frame(spark, rows), CTX, ["hot", "cold"], "type", at, {"cold": "Queued"})
    first = [("a", hour(1), True, None), ("a", hour(1), True, None), ("a", hour(2), True, True), ("b", hour(1), True, False)]
    assert run(first, hour(10))
    new = {("hot", "a", hour(1)): ("New", "SYSTEM"), ("hot", "a", hour(2)): ("New", "SYSTEM"), ("cold", "a", hour(2)): ("Queued", "SYSTEM"), ("hot", "b", hour(1)): ("New", "SYSTEM")}
    assert statuses(table) == new
    assert not run(first, hour(11))  # the same run again
    # of entity a only hour 2 still fires; b is not in this run, and hour 9 lies outside its window
    assert run([("a", hour(1), None, None), ("a", hour(2), True, None)], hour(12))
    want = new | {("hot", "a", hour(1)): ("Resolved", "SYSTEM"), ("cold", "a", hour(2)): ("Resolved", "SYSTEM")}
    assert statuses(table) == want
    assert run([("a", hour(1), True, None), ("a", hour(2), True, True)], hour(13))
    assert statuses(table) == new
    row = table.read().where("data_item_name = 'hot' and entity_id = 'a' and timestamp = timestamp_ntz'2024-01-01 01:00:00'").first()
    assert (row["created_ts"], row["updated_ts"]) == (hour(10), hour(13))
    # a user's change stays
    mine = table.read().where("entity_id = 'b'").withColumn("domain_status", F.lit("Closed"))
    assert A.touch(table, mine, "someone", hour(14))
    assert not run([("b", hour(1), None, None)], hour(15))
    assert statuses(table)["hot", "b", hour(1)] == ("Closed", "someone")
    assert not run([], hour(16))


def test_alerts_as_a_step(spark, tmp_path):
    path = str(tmp_path / "alerts")
    df = frame(spark, [("a", hour(1), True, None)])
    Step("ProduceAlerts", alerts=["hot"], path=path, entity_type="type").apply(df, Context("e", "t", launch=hour(2)))
    assert statuses(A.alert_table(spark, path)) == {("hot", "a", hour(1)): ("New", "SYSTEM")}


def test_alerts_of_a_stream_survive_a_restart(spark, tmp_path):
    source, table = str(tmp_path / "in"), A.alert_table(spark, str(tmp_path / "alerts"), 4)
    frame(spark, [("a", hour(1), True, None)]).coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema("e string, t timestamp_ntz, hot boolean, cold boolean").parquet(source)
        sink = A.alert_sink(table.folder.path, CTX, ["hot"], "type", "stream")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run()
    version = table.manifest().version
    assert statuses(table) == {("hot", "a", hour(1)): ("New", "SYSTEM")}
    # the batch comes again after a crash between the table and the stream's own log
    A.alert_sink(table.folder.path, CTX, ["hot"], "type", "stream")(frame(spark, [("a", hour(1), None, None)]), 0)
    assert table.manifest().version == version
    frame(spark, [("a", hour(1), None, None), ("a", hour(3), True, None)]).coalesce(1).write.mode("append").parquet(source)
    run()
    assert statuses(table) == {("hot", "a", hour(1)): ("Resolved", "SYSTEM"), ("hot", "a", hour(3)): ("New", "SYSTEM")}


# runs


def test_the_log_tells_the_last_state_of_each_run(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "log"), now=lambda: hour(5))
    assert log.runs().count() == 0 and log.last_execution_date("pump", "daily") is None
    one = log.start("pump", "daily", hour(0))
    one.tell("complete", next_execution_date=hour(24), trace="fine")
    log.start("pump", "daily", hour(24)).tell("running", done_until=hour(20))
    log.start("pump", "hourly", hour(24))
    assert log.clear_old_running("pump", "daily") == 1
    assert log.clear_old_running("pump", "daily") == 0
    found = {(r["schedule"], r["execution_date"]): (r["status"], r["next_execution_date"], r["done_until"], r["trace"]) for r in log.runs().collect()}
    assert found == {("daily", hour(0)): ("complete", hour(24), None, "fine"), ("daily", hour(24)): ("abandoned", None, hour(20), None), ("hourly", hour(24)): ("running", None, None, None)}
    assert log.last_execution_date("pump", "daily") == hour(0)
    assert log.done_until("pump", "daily") == hour(20) and log.done_until("pump", "hourly") is None


def test_a_killed_run_is_resumed(spark, tmp_path):
    source = spark.createDataFrame([("a", hour(n), float(n)) for n in range(24 * 4)], "entity_id string, ts timestamp_ntz, v double")
    kind = EntityType("pump", source)
    schedule = {"daily": Schedule(timedelta(days=1), backtrack={"days": 4})}
    path, at = str(tmp_path / "log"), hour(24 * 4)
    seen = []

    class Killed(BaseException):
        """As a lost driver: nothing is logged."""

    def dies(name, result):
        if len(seen) == 2:
            raise Killed
        seen.append(result.rows.count())

    with pytest.raises(Killed):
        JobController(kind, schedule, JobLog(spark, path)).execute(at, dies, timedelta(days=1))
    log = JobLog(spark, path)
    assert [r["status"] for r in log.runs().collect()] == ["running"]
    again = JobController(kind, schedule, log)
    assert again.execute(at + timedelta(hours=1), lambda name, result: seen.append(result.rows.count()), timedelta(days=1)) == ["daily"]
    assert sum(seen) == 24 * 4 and len(seen) > 3  # each row once
    assert sorted(r["status"] for r in log.runs().collect()) == ["abandoned", "complete"]
    assert again.execute(at + timedelta(hours=2), dies) == []  # not due


def test_a_failed_run_is_logged(spark, tmp_path):
    source = spark.createDataFrame([("a", hour(1), 1.0)], "entity_id string, ts timestamp_ntz, v double")
    log = JobLog(spark, str(tmp_path / "log"))
    with pytest.raises(ZeroDivisionError):
        JobController(EntityType("pump", source), {"daily": Schedule(timedelta(days=1))}, log).execute(hour(30), lambda *_: 1 // 0)
    row = log.runs().first()
    assert row["status"] == "aborted" and "division" in row["execution_log"]


def test_without_a_log_all_schedules_are_due(spark):
    source = spark.createDataFrame([("a", hour(1), 1.0)], "entity_id string, ts timestamp_ntz, v double")
    jobs = JobController(EntityType("pump", source), {"daily": Schedule(timedelta(days=1)), "hourly": Schedule(timedelta(hours=1))}, NoJobLog())
    ran = []
    for _ in range(2):
        assert jobs.execute(hour(30), lambda name, result: ran.append((name, result.rows.count()))) == ["hourly", "daily"]
    assert ran == [("hourly", 1), ("daily", 1)] * 2
