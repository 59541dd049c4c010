"""Generators, sample entity types, controls, sinks, table kinds, helpers and streams without data."""

import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.catalog import CATALOG, Context, Step, load_catalog, operator, scope_mask
from tidewell.functions import scalars
from tidewell.functions.expressions import names_in
from tidewell.functions.transforms import schema_changes
from tidewell.operators import anomaly, generators, joins
from tidewell.operators.alerts import no_data_alerts
from tidewell.plans import controls, samples
from tidewell.plans.pipeline import CalcPipeline, window_start
from tidewell.sources import tables
from tidewell.sources.staging import staged
from tidewell.streaming.alerts import no_data_alerts_stream

START, END = datetime(2024, 1, 1), datetime(2024, 1, 3)
CTX = Context("id", "ts")


def points(spark, rows):
    return spark.createDataFrame([(e, START + timedelta(seconds=s), float(v)) for e, s, v in rows], "id string, ts timestamp_ntz, v double")


# generators


def test_generated_series(spark):
    made = generators.time_series(spark, ["a", "b"], START, END, {"m": (100.0, 10.0), "flat": (5.0, 0.0)}, {"kind": ["x", "y"]}, ["seen"], freq="1 hour")
    again = generators.time_series(spark, ["a", "b"], START, END, {"m": (100.0, 10.0), "flat": (5.0, 0.0)}, {"kind": ["x", "y"]}, ["seen"], freq="1 hour")
    rows = made.orderBy("entity_id", "ts").collect()
    assert rows == again.orderBy("entity_id", "ts").collect()
    assert [(r["entity_id"], r["ts"]) for r in rows] == [(e, START + timedelta(hours=h)) for e in "ab" for h in range(49)]
    assert {r["flat"] for r in rows} == {5.0} and {r["kind"] for r in rows} == {"x", "y"}
    m = np.array([r["m"] for r in rows])
    assert abs(m.mean() - 100) < 2 and 0.5 < m.std() < 5
    assert all(timedelta(0) <= r["ts"] - r["seen"] <= timedelta(days=30) for r in rows)
    hour = {h: np.mean([r["m"] for r in rows if r["ts"].hour == h]) for h in (6, 18)}
    assert hour[6] > hour[18]  # the day's harmonic


def test_generated_dimensions_activities_and_changes(spark):
    dim = generators.dimension(spark, ["a", "b", "c"], {"load": (7.0, 0.0)}, {"maker": ["m"]}).collect()
    assert sorted((r["entity_id"], r["load"], r["maker"]) for r in dim) == [(e, 7.0, "m") for e in "abc"]
    acts = generators.activities(spark, ["a", "b"], ["PM", "UM"], START, END).collect()
    assert 5 < len(acts) < 60 and all(r["end_date"] >= r["start_date"] and r["activity"] in ("PM", "UM") for r in acts)
    late = START + timedelta(days=40)
    change = generators.changes(spark, ["a", "b"], "crew", ["x", "y"], START, late).orderBy("entity_id", "start_date").collect()
    for r, following in zip(change, change[1:]):
        assert r["end_date"] > r["start_date"]
        if r["entity_id"] == following["entity_id"]:
            assert r["end_date"] <= following["start_date"]
    assert {r["crew"] for r in change} == {"x", "y"}


def test_generator_steps_add_rows(spark):
    df = points(spark, [("a", 0, 1.0)])
    ctx = Context("id", "ts", start=START, end=START + timedelta(hours=1))
    for name, extra in (("EntityDataGenerator", {"parameters": {"freq": "10 minutes"}}), ("DeviceDataGenerator", {})):
        out = Step(name, ids=["x", "y"], **extra).apply(df, ctx)
        assert out.columns == df.columns
        assert out.where("id = 'x'").count() == (7 if extra else 13) and out.where("id = 'a'").count() == 1


def test_offsets_carry_on_a_run(spark):
    df = points(spark, [("a", s, s) for s in range(7)] + [("b", 0, 0)])
    seen = generators.next_offsets(df, CTX)
    assert {r["id"]: r["offset"] for r in seen.collect()} == {"a": 7, "b": 1}
    more = points(spark, [("a", 100 + s, s) for s in range(5)])
    assert {r["id"]: r["offset"] for r in generators.next_offsets(more, CTX, seen).collect()} == {"a": 12, "b": 1}
    out = Step("AnomalyGeneratorNoData", input_item="v", width=1, factor=4, output_item="z", offsets=seen).apply(more, CTX)
    assert [r["z"] is None for r in out.orderBy("ts").collect()] == [True, False, False, False, True]  # rows 7 to 11 of the entity


# sample entity types


@pytest.mark.parametrize("name", sorted(samples.SAMPLES))
def test_sample_entity_types_run(spark, name):
    kind = samples.SAMPLES[name](spark)
    result = CalcPipeline(kind).execute()
    made = {c for s in kind.steps for c in s.outputs}
    rows = result.rows.toPandas()
    # activities of the robot begin between its rows and add theirs
    assert (len(rows) >= 5 * 577 if name == "Robot" else len(rows) == 5 * 577) and made <= set(rows.columns) and not result.messages
    day = result.grains["day"].toPandas()
    assert set(day["entity_id"]) == set(rows["entity_id"]) and len(day) == 15
    for item in next(v for g, v in kind.aggregates.items() if g.name == "day"):
        if item.function == "Mean":
            want = rows.groupby(["entity_id", rows["ts"].dt.floor("D")])[item.source].mean()
            got = day.set_index(["entity_id", "ts"])[item.name]
            assert np.allclose(want.sort_index(), got.sort_index())
    if kind.alerts:
        fired = result.alerts.groupBy("data_item_name").count().collect()
        assert {r["data_item_name"]: r["count"] for r in fired} == {a: int(n) for a in kind.alerts if (n := rows[a].fillna(False).astype(bool).sum())}
    assert kind.unmatched_members().count() == 0
    numbers = {c: "value_n" for c in made if rows[c].dtype == float}
    if numbers:
        wide = tables.from_long(result.derived, ["entity_id", "ts"], numbers).toPandas()
        for c in numbers:
            assert np.isclose(wide[c].sum(), rows[c].sum())


def test_the_blank_type_and_the_bed(spark):
    assert samples.blank(spark).steps == []
    rows = CalcPipeline(samples.test_bed(spark)).execute().rows.toPandas()
    assert np.allclose(rows["double_x"], 2 * rows["x_1"]) and np.allclose(rows["age_days"], 42) and np.allclose(rows["either"], rows["x_1"])
    assert rows["only_a"].notna().equals(rows["s_1"] == "A") and 0.02 < (rows["noisy"] - rows["x_1"]).std() < 0.2


# controls


def test_controls(spark):
    df = points(spark, [("a", 0, 1.0), ("a", 1, 4.0)])
    with pytest.raises(RuntimeError):
        Step("RaiseError", halt_after="x").apply(df, CTX)
    assert Step("RaiseError", halt_after="x", abort_execution=False).apply(df, CTX).where("raised").count() == 2
    found = Step("PackageInfo", package_names=["numpy", "no-such-package"], version_output=["n", "none"]).apply(df, CTX).first()
    assert found["n"] == np.__version__ and found["none"] is None
    ctx = Context("id", "ts", constants={"b": 2, "a": "x"})
    assert Step("TraceConstants").apply(df, ctx).first()["trace_constants"] == '{"a": "x", "b": "2"}' == ctx.settings["trace"][0]
    Step("CalcSettings", checkpoint_by_entity=False, production_mode=None).apply(df, ctx)
    assert ctx.settings["checkpoint_by_entity"] is False and "production_mode" not in ctx.settings


def test_registered_functions(spark):
    df = points(spark, [("a", 0, 1.0), ("a", 1, 4.0), ("b", 1, 6.0)])
    controls.make_function("times", lambda rows, p: rows["v"] * p["by"])
    out = Step("PythonFunction", function="times", input_items=["v"], output_item="z", parameters={"by": 3}).apply(df, CTX)
    assert sorted(r["z"] for r in out.collect()) == [3.0, 12.0, 18.0]
    stored = Step("StoredFunction", function_name="times", input_items=["v"], parameters={"by": 2}).apply(df, CTX)
    assert sorted(r["times"] for r in stored.collect()) == [2.0, 8.0, 12.0]
    whole = controls.apply_per_group(df, ["id"], lambda f: f.assign(v=f["v"] - f["v"].mean()), "id string, ts timestamp_ntz, v double")
    assert sorted(r["v"] for r in whole.collect()) == [-1.5, 0.0, 1.5]

    @operator("Halved", inputs=("item",), outputs=("output",))
    def halved(df, ctx, item, output):
        return df.withColumn(output, F.col(item) / 2)

    try:
        assert "Halved" in load_catalog()
        step = Step("Halved", item="v", output="h")
        assert step.inputs == {"v"} and step.outputs == ["h"]
        assert sorted(r["h"] for r in step.apply(df, CTX).collect()) == [0.5, 2.0, 3.0]
    finally:
        CATALOG.pop("Halved")


# helpers


def test_names_scopes_and_schema_changes(spark):
    assert names_in("${a} + df['b'] * c_1 if ${a} > np.abs(x) else 3") >= {"a", "b", "c_1"}
    step = Step("Alert", name="hot", expression="${v} > 2 and ${w} < 3", scope={"kind": ["x", None]})
    assert step.inputs == {"v", "w", "kind"}
    df = points(spark, [("a", 0, 1.0), ("a", 1, 4.0)]).withColumns({"w": F.lit(1), "kind": F.when(F.col("v") > 2, "x").otherwise("y")})
    assert [r["hot"] for r in step.apply(df, CTX).orderBy("ts").collect()] == [None, True]
    assert df.where(scope_mask("${v} > 2", CTX)).count() == 1
    assert schema_changes(df, df.drop("w").withColumn("v", F.col("v").cast("string"))) == ["w is gone", "v: double became string"]
    assert joins.is_mergeable(df.select("id", "ts"), df, ["id", "ts"]) and not joins.is_mergeable(df.limit(1), df, ["id", "ts"])
    assert not joins.is_mergeable(df.withColumn("ts", F.col("ts") + F.expr("interval 1 day")), df, ["id", "ts"])


def test_broadcasts_go_by_bytes(spark):
    long_ = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().logical().toString() or "UnresolvedHint" in df._jdf.queryExecution().logical().toString()
    assert hinted(joins.small(long_)) and not hinted(joins.small(long_, rows=9)) and not hinted(joins.small(long_, most=5000))
    nested = spark.range(10).select(F.array_repeat(F.lit(1), 1000).alias("a"))
    assert hinted(joins.small(nested)) and not hinted(joins.small(nested, most=5000)) and hinted(joins.small(nested.limit(0)))


def test_look_back_and_windows():
    assert scalars.backtrack_of("D") == {"days": 1, "hour": 0, "minute": 0, "second": 0} and scalars.backtrack_of("15min") == {"minutes": 15, "second": 0}
    assert scalars.split_frequency("15T") == (15, "min")
    at = datetime(2024, 3, 15, 10, 20)
    assert window_start(at, {"days": 2}) == datetime(2024, 3, 13) and window_start(at, {"months": 1}) == datetime(2024, 2, 1) and window_start(at, None) is None
    assert window_start(at, {"days": 2}, datetime(2024, 3, 14, 1)) == datetime(2024, 3, 14, 1)


def test_dampened_scores():
    x = np.array([1.0, 2.0, 4.0, 4.0, 1.0])
    step = np.gradient(x)
    assert np.allclose(anomaly.dampen(x, 0.5), np.cumsum(np.sign(step) * np.sqrt(np.abs(step)))) and (anomaly.dampen(x, 1) == x).all()


def test_change_points_equal_plain_merging():
    def plain(x, count=15, jump=2):
        edges = [*range(0, len(x), jump), len(x)]
        cost = lambda a, b: ((x[a:b] - x[a:b].mean()) ** 2).sum()
        while len(edges) - 2 > count:
            rises = [cost(a, c) - cost(a, b) - cost(b, c) for a, b, c in zip(edges, edges[1:], edges[2:])]
            edges.pop(int(np.argmin(np.round(rises, 9))) + 1)
        return edges[1:-1]

    rng = np.random.default_rng(4)
    for n in (5, 31, 90, 201):
        x = rng.normal(size=n) + 5 * (np.arange(n) > n // 2)
        assert anomaly.change_points(x, 4) == plain(x, 4)
    assert anomaly.change_points(np.zeros(3)) == [2]


def test_company_lookup(spark):
    df = points(spark, [("a", 0, 1.0)]).withColumn("company", F.lit("ACME"))
    found = Step("LookupCompany", lookup_items=["inception_date", "employee_count"], output_items=["since", "staff"]).apply(df, CTX).first()
    assert found["since"] == datetime(1988, 1, 1, 5) and found["staff"] == 120


def test_spectral_parts(spark):
    rng = np.random.default_rng(1)
    df = points(spark, [("a", 60 * i, v) for i, v in enumerate(np.sin(np.arange(200) / 3) + rng.normal(size=200) / 10 + 3 * (np.arange(200) == 120))])
    out = Step("SpectralAnomalyScoreExt", input_item="v", output_item="s", inv_zscore="inverse", signal_energy="energy", windowsize=12).apply(df, CTX).orderBy("ts").toPandas()
    t = (out["ts"].astype("int64") / 1e6).to_numpy()
    for name, want in zip(("s", "inverse", "energy"), anomaly.spectral(out["v"].to_numpy(), t, 12, ("score", "inverse", "energy"))):
        assert np.allclose(out[name], anomaly.stretch(want, 200))
    assert 108 <= out["s"].idxmax() <= 132


# sinks and tables


def test_files_and_tables(spark, tmp_path):
    df = points(spark, [("a", 0, 1.0), ("b", 1, 4.0)])
    Step("DataWriterFile", path=str(tmp_path / "csv")).apply(df, CTX)
    assert sorted(r["v"] for r in tables.open_table(spark, str(tmp_path / "csv"), "csv").collect()) == [1.0, 4.0]
    out = Step("SaveDataFrame", filename=str(tmp_path / "saved"), columns=["id", "v"]).apply(df, CTX)
    assert out.where("save_df_result").count() == 2 and spark.read.parquet(str(tmp_path / "saved")).columns == ["id", "v"]
    name = f"t_{uuid.uuid4().hex}"
    assert not tables.table_exists(spark, name)
    done = Step("WriteDataFrame", input_items=["v"], out_table_name=name).apply(df, CTX)
    assert done.where("output_status").count() == 2 and tables.table_exists(spark, name)
    assert sorted(map(tuple, tables.open_table(spark, name, "table").select("id", "v").collect())) == [("a", 1.0), ("b", 4.0)]
    tables.truncate(spark, name)
    assert spark.table(name).count() == 0
    tables.write_frame(df, name, "replace", datetime(2024, 5, 1))
    assert {r["version_date"] for r in spark.table(name).collect()} == {datetime(2024, 5, 1)}
    tables.drop_table(spark, name)
    log = f"log_{uuid.uuid4().hex}"
    for _ in range(2):
        Step("SamplePreLoad", table_name=log, output_item="done").apply(df, Context("id", "ts", launch=START))
    assert [tuple(r) for r in spark.table(log).collect()] == [(START, "True")] * 2
    tables.drop_table(spark, log)


def test_old_rows_are_deleted_by_partition(spark, tmp_path):
    path = str(tmp_path / "days")
    df = points(spark, [("a", 86_400 * d, d) for d in range(6)]).withColumn("day", F.to_date("ts"))
    tables.replace_where(df, path, "day")
    kept = tables.delete_older(spark.read.parquet(path), "ts", 2, START + timedelta(days=5))
    assert sorted(r["v"] for r in kept.collect()) == [3.0, 4.0, 5.0]
    tables.replace_where(staged(kept.where("v = 3").withColumn("v", F.lit(33.0))), path, "day")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [0.0, 1.0, 2.0, 4.0, 5.0, 33.0]


@pytest.mark.parametrize("schema, columns", [
    (tables.series_schema({"v": "double"}), ["deviceid", "evt_timestamp", "devicetype", "logicalinterface_id", "eventtype", "format", "updated_utc", "v"]),
    (tables.ACTIVITY, ["deviceid", "start_date", "end_date", "activity"]), (tables.RESOURCE_CALENDAR, ["deviceid", "start_date", "end_date", "resource_id"]),
    (tables.change_schema("crew"), ["deviceid", "start_date", "end_date", "crew"]), (tables.dimension_schema({"load": "double"}), ["deviceid", "load"]),
    (tables.system_log_schema({"status": "string"}), ["timestamp_utc", "status"]),
])
def test_table_kinds(spark, schema, columns):
    name = f"k_{uuid.uuid4().hex}"
    tables.create_table(spark, name, schema)
    tables.create_table(spark, name, schema)
    assert spark.table(name).columns == columns
    tables.drop_table(spark, name)


# streams


def test_streamed_gaps_are_those_of_a_batch(spark, tmp_path):
    rows = [("a", 0), ("a", 30), ("a", 400), ("b", 10), ("a", 410), ("b", 800), ("c", 5), ("a", 900), ("z", 5000)]
    name, folder = f"s_{uuid.uuid4().hex}", str(tmp_path / "in")
    for i in range(0, len(rows), 2):
        spark.createDataFrame([(e, START + timedelta(seconds=s)) for e, s in rows[i : i + 2]], "id string, ts timestamp").coalesce(1).write.parquet(f"{folder}/b={i}")
    stream = spark.readStream.schema("id string, ts timestamp, b int").option("maxFilesPerTrigger", 1).parquet(folder)
    found = no_data_alerts_stream(stream, "id", "ts", 100, "1 hour", 150)
    running = found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert running.awaitTermination(120)
    got = {(r["e"], r["t"]) for r in spark.table(name).collect()}
    end = START + timedelta(seconds=5000 - 3600)  # the watermark
    df = points(spark, [(e, s, 0) for e, s in rows])
    want = {(r["id"], r["ts"]) for r in no_data_alerts(df.where("id <> 'z'"), CTX, 100, 150, end=end).collect()}
    assert got == want and len(want) > 10
