"""Series of the dashboard; gaps stay null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.operators import schedule, timeline
from gridlore.operators.rules import Thresholds

SERIES = {
    "pv": ["pv_forecast_kw", "pv_actual_kw"],
    "load_and_capacity": ["load_kw", "load_forecast_kw", "contract_capacity_kw"],
    "soc": ["battery_soc"],
    "battery_power": ["battery_power_kw"],
    "price": ["electricity_price"],
}


def axis_label(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "MM/dd HH:mm"), F.lit("—"))


def valid(c: Column) -> Column:
    """A finite number."""
    x = c.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def series(readings: DataFrame, name: str) -> DataFrame:
    return readings.select("site_id", "timestamp", axis_label(F.col("timestamp")).alias("label"), *SERIES[name])


def dashboard(readings: DataFrame, t: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """The eight series: five of columns by reading, cost comparison and green index by day, anomalies by period."""
    found = {name: series(readings, name) for name in SERIES}
    return found | {"cost": schedule.before_after(readings, t), "green_index": schedule.green_index(readings, t), "anomaly_timeline": timeline.periods(readings, t=t)}


def bounds(readings: DataFrame) -> DataFrame:
    """For each column of each series: whether it has a valid number, and its extent. One scan."""
    columns = [(s, c) for s, cs in SERIES.items() for c in cs]
    found = readings.agg(*(f.alias(f"{c}_{n}") for _, c in columns for n, f in (("n", F.count_if(valid(F.col(c)))), ("low", F.min(F.when(valid(F.col(c)), F.col(c)))), ("high", F.max(F.when(valid(F.col(c)), F.col(c)))))))
    rows = F.array(*(F.struct(F.lit(s).alias("series"), F.lit(c).alias("column"), (F.col(f"{c}_n") > 0).alias("available"), F.col(f"{c}_low").alias("low"), F.col(f"{c}_high").alias("high")) for s, c in columns))
    return found.select(F.explode(rows).alias("r")).select("r.*")
