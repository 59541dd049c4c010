"""Sample entity types over generated data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession

from tidewell.catalog import Step
from tidewell.operators.aggregate import Aggregate, Granularity
from tidewell.operators.generators import activities, changes, dimension, time_series
from tidewell.plans.pipeline import EntityType

DAY = Granularity("day", "D")
HOUR = Granularity("hour", "h")


def make_sample(spark: SparkSession, name: str, metrics: dict[str, tuple[float, float]], steps: list[Step] | None = None, aggregates: dict | None = None, entities: int = 5, start: datetime = datetime(2024, 1, 1), end: datetime = datetime(2024, 1, 3), freq: str = "5 minutes", categoricals: dict[str, list[str]] | None = None, **fields) -> EntityType:
    ids = [f"{name}{i:02d}" for i in range(entities)]
    source = time_series(spark, ids, start, end, metrics, categoricals, freq=freq)
    dim = dimension(spark, ids, domains={"manufacturer": ["maker_1", "maker_2"]})
    return EntityType(name, source, dimension=dim, steps=steps or [], aggregates=aggregates or {DAY: [Aggregate("Mean", m, f"mean_{m}") for m in metrics]}, **fields)


def blank(spark: SparkSession) -> EntityType:
    return make_sample(spark, "blank", {"x": (0.0, 1.0)})


def boiler(spark: SparkSession) -> EntityType:
    steps = [
        Step("IfThenElse", conditional_expression="${temp_set_point} > 55", true_expression="${temp_set_point}", false_expression="0", output_item="hot_set_point"),
        Step("AlertHighValue", input_item="pressure", upper_threshold=520, alert_name="high_pressure"),
        Step("PythonExpression", expression="${input_flow_rate} - ${fuel_flow_rate}", output_name="discharge"),
    ]
    metrics = {"temp_set_point": (50.0, 10.0), "pressure": (500.0, 50.0), "input_flow_rate": (100.0, 10.0), "fuel_flow_rate": (10.0, 1.0), "air_flow_rate": (50.0, 5.0)}
    return make_sample(spark, "boiler", metrics, steps, categoricals={"company_code": ["ABC", "ACME", "JDI"]}, alerts=["high_pressure"])


def robot(spark: SparkSession) -> EntityType:
    """Shifts, activities, a changing property and efficiency by plant and shift."""
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 3)
    ids = [f"robot{i:02d}" for i in range(5)]
    steps = [
        Step("ShiftCalendar", shift_definition={"1": [5.5, 14], "2": [14, 21], "3": [21, 29.5]}),
        Step("SCDLookup", table_name="operator_changes", output_item="operator", property_name="operator"),
        Step("ActivityDuration", table_name="maintenance", activity_codes=["PM", "UM"], activity_duration="maintenance_minutes"),
        Step("PythonExpression", expression="${load} * ${speed} / 100", output_name="work"),
        Step("AlertExpression", expression="${acc} > 6 and ${torque} > 12", alert_name="strain"),
    ]
    shift = Granularity("shift", None, ("shift_day", "shift_id"), True)
    aggregates = {DAY: [Aggregate("Sum", "work", "daily_work"), Aggregate("Maximum", "torque", "max_torque")], shift: [Aggregate("Mean", "work", "shift_work")]}
    tables = {"operator_changes": changes(spark, ids, "operator", ["operator_1", "operator_2", "operator_3"], start, end), "maintenance": activities(spark, ids, ["PM", "UM"], start, end)}
    metrics = {"acc": (5.0, 2.0), "torque": (10.0, 4.0), "load": (80.0, 10.0), "speed": (3.0, 1.0), "travel_time": (1.0, 0.2)}
    return make_sample(spark, "robot", metrics, steps, aggregates, start=start, end=end, categoricals={"plant_code": ["plant_1", "plant_2"]}, tables=tables, alerts=["strain"])


def workstation(spark: SparkSession) -> EntityType:
    return make_sample(spark, "workstation", {"temperature": (22.0, 3.0), "occupancy": (1.0, 1.0)}, [Step("AlertOutOfRange", input_item="temperature", lower_threshold=18, upper_threshold=26, output_alert_upper="too_hot", output_alert_lower="too_cold")], alerts=["too_hot", "too_cold"])


def packaging_hopper(spark: SparkSession) -> EntityType:
    return make_sample(spark, "hopper", {"ambient_temp": (20.0, 3.0), "ambient_humidity": (60.0, 5.0), "dispensed_mass": (7.0, 1.0)}, [Step("OutlierRemover", name="clean_mass", source="dispensed_mass", min=0, max=20)])


def sourdough(spark: SparkSession) -> EntityType:
    return make_sample(spark, "sourdough", {"temp": (24.0, 2.0), "ph": (4.5, 0.5)}, [Step("Derivative", input_item="temp", output_item="temp_change")])


def test_bed(spark: SparkSession) -> EntityType:
    steps = [
        Step("Coalesce", data_items=["x_1", "x_2"], output_item="either"),
        Step("MultiplyByFactor", input_items=["x_1"], factor=2, output_items=["double_x"]),
        Step("DateDifference", date_1="d_1", num_days="age_days"),
        Step("RandomNoise", input_items=["x_1"], standard_deviation=0.1, output_items=["noisy"]),
        Step("Filter", names=["only_a"], filtered_sources=["x_2"], expression="${s_1} == 'A'"),
    ]
    out = make_sample(spark, "testbed", {"x_1": (1.0, 0.5), "x_2": (5.0, 1.0), "x_3": (0.0, 1.0)}, steps, categoricals={"s_1": ["A", "B"]})
    from pyspark.sql import functions as F

    out.source = out.source.withColumn("d_1", F.col("ts") - F.expr("interval 42 days"))
    return out


SAMPLES = {"SampleBlankEntity": blank, "Boiler": boiler, "Robot": robot, "BuildingWorkstation": workstation, "PackagingHopper": packaging_hopper, "SourdoughLeavening": sourdough, "TestBed": test_bed}
