"""Seeded random columns, helpers on the driver, sinks and stateful streams."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.catalog import Context, Step
from tidewell.functions import scalars
from tidewell.operators.aggregate import time_interval
from tidewell.operators.alerts import OccurrenceRule
from tidewell.sources import tables
from tidewell.streaming import alerts as stream_alerts

CTX = Context("id", "ts")
START = datetime(2024, 1, 1)


def rows(spark, n=2000):
    return spark.range(n).select((F.col("id") % 5).alias("id"), (F.lit(START) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("v"))


def test_random_columns(spark):
    df = rows(spark)
    for kind, parameters in (
        ("RandomUniform", {"min_value": 2.0, "max_value": 5.0, "output_item": "u"}),
        ("RandomNormal", {"mean": 10.0, "standard_deviation": 2.0, "output_item": "n"}),
        ("RandomNoise", {"input_items": ["v"], "standard_deviation": 0.5, "output_items": ["noisy"]}),
        ("RandomNull", {"input_items": ["v"], "output_items": ["holes"]}),
        ("RandomChoiceString", {"domain_of_values": ["a", "b"], "probabilities": [0.8, 0.2], "output_item": "c"}),
        ("RandomDiscreteNumeric", {"discrete_values": [1, 2, 4], "output_item": "d"}),
    ):
        df = Step(kind, **parameters).apply(df, CTX)
    found = df.agg(
        F.min("u"), F.max("u"), F.avg("n"), F.stddev("n"), F.stddev(F.col("noisy") - F.col("v")), F.avg(F.col("holes").isNull().cast("int")),
        F.avg((F.col("c") == "a").cast("int")), F.sort_array(F.collect_set("d")), F.max(F.abs(F.col("holes") - F.col("v"))),
    ).first()
    assert found[0] >= 2 and found[1] < 5
    assert [round(x, 6) for x in found[2:7]] == pytest.approx([10, 2, 0.5, 0.5, 0.8], rel=0.15)
    assert found[7] == [1.0, 2.0, 4.0] and found[8] == 0


def test_frequencies_and_windows():
    assert scalars.normalise_frequency("5T") == "5min" and scalars.normalise_frequency("1H") == "h"
    assert scalars.max_frequency(["15min", "D", "6h"]) == "D" and scalars.compare_frequency("5min", "15min") == -1 and scalars.compare_frequency("h", "H") == 0
    assert scalars.frequency_delta("15min") == timedelta(minutes=15)
    assert scalars.complete_backtrack({"days": 1}) == {"days": 1, "hour": 0, "minute": 0, "second": 0}
    at = datetime(2024, 2, 14, 9, 41, 7)  # a Wednesday
    assert scalars.roll(at, "W") == datetime(2024, 2, 11) and scalars.roll(at, "W", True) == datetime(2024, 2, 18)
    assert scalars.roll(at, "MS", True) == datetime(2024, 3, 1) and scalars.roll(at, "YS", True) == datetime(2025, 1, 1)
    assert scalars.adjust_probabilities([1, 3]) == [0.25, 0.75]
    with pytest.raises(ValueError):
        scalars.adjust_probabilities([0.0])
    assert scalars.window_and_overlap(30) == (24, 12) and scalars.window_and_overlap(1) == (1, 0)
    assert time_interval(None, at, "days", 2) == (at - timedelta(days=2), at)
    assert time_interval(at, None, "hours", 3) == (at, at + timedelta(hours=3))
    assert time_interval(None, at, "mtd") == (datetime(2024, 2, 1), at)


def test_columns_and_row_limit(spark):
    df = rows(spark, 10).withColumn("s", F.lit("x")).withColumn("code", F.lit(1))
    assert tables.column_kinds(df, ["id"], {"code"}) == {"metrics": ["v"], "dates": ["ts"], "categoricals": ["s", "code"], "others": []}
    assert tables.check_row_limit(df, 10) and not tables.check_row_limit(df, 9)


def test_persisted_columns_are_upserted(spark, tmp_path):
    path, df = str(tmp_path / "long"), rows(spark, 20)
    Step("PersistColumns", items=["v"], path=path).apply(df, CTX)
    Step("PersistColumns", items=["v"], path=path).apply(df.where("v < 5").withColumn("v", F.col("v") + 100), CTX)
    found = tables.from_long(spark.read.parquet(path), ["id", "ts"], {"v": "value_n"})
    assert sorted(r["v"] for r in found.collect()) == sorted([*range(5, 20), *range(100, 105)])


def test_tables_are_appended_to_and_dropped(spark):
    name = f"t_{uuid.uuid4().hex}"
    tables.create_table(spark, name, "id long, ts timestamp_ntz, v double, more string")
    tables.write_frame(rows(spark, 4), name)
    tables.write_frame(rows(spark, 3), name)
    assert spark.table(name).count() == 7 and spark.table(name).where("more is null").count() == 7
    with pytest.raises(ValueError):
        tables.write_frame(rows(spark, 1).withColumn("unknown", F.lit(1)), name)
    tables.drop_table(spark, name, recreate=True)
    assert spark.table(name).count() == 0
    tables.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def streamed(spark, tmp_path, batches, transform):
    """All rows of a stream over one file a batch."""
    folder, name = tmp_path / "in", f"s_{uuid.uuid4().hex}"
    for i, batch in enumerate(batches):
        spark.createDataFrame([(e, START + timedelta(seconds=s), v) for e, s, v in batch], "id string, ts timestamp, v double").coalesce(1).write.parquet(str(folder / f"b={i}"))
    source = spark.readStream.schema("id string, ts timestamp, v double, b int").option("maxFilesPerTrigger", 1).parquet(str(folder))
    running = transform(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert running.awaitTermination(120)
        return spark.table(name).collect()
    finally:
        running.stop()


def test_occurrences_carry_over_batches(spark, tmp_path):
    rule = OccurrenceRule(3, 100.0, True, False, 0.0)
    batches = [[("a", 0, 9.0), ("a", 10, 9.0), ("b", 10, 9.0)], [("a", 20, 9.0), ("b", 500, 9.0), ("b", 510, 1.0)]]
    found = streamed(spark, tmp_path, batches, lambda s: stream_alerts.occurrence_alerts(s, "id", "ts", F.col("v") > 5, rule))
    assert [(r["e"], r["t"]) for r in found] == [("a", START + timedelta(seconds=20))]


def test_windowed_means_wait_for_the_watermark(spark, tmp_path):
    batches = [[("a", 0, 1.0), ("a", 60, 3.0)], [("a", 4000, 5.0)], [("a", 90_000, 7.0)]]
    found = streamed(spark, tmp_path, batches, lambda s: stream_alerts.windowed_means(s, "id", "ts", "v"))
    assert sorted((r["start"], r["mean_v"], r["n"]) for r in found) == [(START, 2.0, 2), (START + timedelta(hours=1), 5.0, 1)]
