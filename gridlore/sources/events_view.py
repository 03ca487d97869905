"""Energy readings derived from the ``events`` table: one deterministic reading for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def energy_view(events: DataFrame) -> DataFrame:
    """id, dataset_id and energy columns computed from event_id, ts, user_id, event_type and value."""
    n = F.col("event_id")
    number = lambda c: c.cast("double")
    return events.select(
        n.alias("id"),
        F.col("ts").alias("timestamp"),
        (F.col("user_id") % 5 + 1).alias("dataset_id"),
        F.concat(F.lit("site_"), (F.col("user_id") % 3).cast("string")).alias("site_id"),
        F.col("value").alias("pv_forecast_kw"),
        (F.col("value") * (number(5 + n % 11) / F.lit(10.0))).alias("pv_actual_kw"),
        number(40 + n % 61).alias("load_kw"),
        F.lit(70.0).alias("load_forecast_kw"),
        number(n % 101).alias("battery_soc"),
        number(n % 41 - 20).alias("battery_power_kw"),
        number(20 + n % 25).alias("battery_temperature"),
        (F.lit(2.0) + number(n % 5) * F.lit(0.75)).alias("electricity_price"),
        F.lit(100.0).alias("contract_capacity_kw"),
        number(50 + (n * 7) % 60).alias("grid_import_kw"),
        F.when(n % 9 == 0, F.col("value")).otherwise(F.lit(0.0)).alias("grid_export_kw"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "manual").otherwise("auto").alias("ems_mode"),
        F.when(n % 50 == 0, "fault").otherwise("normal").alias("equipment_status"),
        number(70 + n % 31).alias("battery_soh"),
        (n % 997).cast("int").alias("battery_cycle_count"),
        F.when(n % 17 == 0, "critical").when(n % 7 == 0, "warning").otherwise("normal").alias("battery_health_status"),
        (n % 2 == 0).alias("battery_is_second_life"),
        F.lit(500.0).alias("battery_rated_capacity_kwh"),
        number(500 - n % 100).alias("battery_available_capacity_kwh"),
    )


def read_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy_view(spark.read.parquet(f"{sf_dir}/events.parquet"))
