"""The rules over a stream of readings. The reference has no streams; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.operators import rules
from gridlore.operators.rules import Thresholds


def anomaly_stream(readings: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Anomalies as they come: the rules are functions of one reading, so there is no state."""
    return rules.anomalies(readings, t)


def hourly(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Readings, mean load and import of each site and hour; readings later than ``late`` are left out."""
    stamped = readings.withColumn("at", F.col("timestamp").cast("timestamp"))
    windowed = stamped.withWatermark("at", late).groupBy("site_id", F.window("at", "1 hour"))
    return windowed.agg(F.count("*").alias("readings"), F.avg("load_kw").alias("mean_load_kw"), F.sum("grid_import_kw").alias("import_kwh")).select(
        "site_id", F.col("window.start").alias("hour"), "readings", "mean_load_kw", "import_kwh"
    )
