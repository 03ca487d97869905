"""Battery suggestions, costs and the green operations index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.operators.rules import Thresholds, _yes, flag, near_capacity, price_is_high, price_is_low
from gridlore.operators.timeline import days_of, joined_days, run_columns, within_days

c = F.col


def _unsafe(t: Thresholds) -> Column:
    return _yes(c("battery_temperature") >= t.temperature_high) | _yes(c("battery_health_status") == "critical")


def action(t: Thresholds = Thresholds()) -> Column:
    """idle before discharge before charge before none: safety first."""
    idle = _yes(c("battery_soc") <= t.soc_low) | _unsafe(t)
    discharge = _yes(price_is_high(t) & (c("battery_soc") > t.soc_discharge) & near_capacity(t.discharge_import))
    charge = _yes(price_is_low(t) & (c("battery_soc") < t.soc_charge)) | _yes((c("pv_actual_kw") > c("load_kw")) & (c("battery_soc") < t.soc_full))
    return F.when(idle, "idle").when(discharge, "discharge").when(charge & ~_unsafe(t), "charge").otherwise("none")


def mode(t: Thresholds = Thresholds()) -> Column:
    """For a discharge, whether it should be gentle."""
    gentle = _unsafe(t) | _yes(c("battery_soh") < t.soh_low)
    return F.when(action(t) == "discharge", F.when(gentle, "not_aggressive").otherwise("normal"))


_REASONS = {"idle": "battery is low, hot or critical", "discharge": "price and grid import are high and the battery is charged", "charge": "price is low or solar output exceeds load"}
_RISKS = {"idle": "none", "discharge": "battery wear", "charge": "battery wear"}


def _of(action_column: Column, values: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for k, v in values.items():
        found = F.when(action_column == k, v).otherwise(found)
    return found


def suggestions(readings: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Each reading's action, with reason, risk, and its effect on cost and on green energy."""
    a = action(t)
    cost = F.when(a == "discharge", -F.abs("battery_power_kw") * c("electricity_price")).when(a == "charge", F.abs("battery_power_kw") * c("electricity_price")).otherwise(0.0)
    green = F.when((a == "charge") & _yes(c("pv_actual_kw") > c("load_kw")), c("pv_actual_kw") - c("load_kw")).otherwise(0.0)
    return readings.select(
        "id", "dataset_id", "site_id", "timestamp", a.alias("action"), mode(t).alias("mode"), _of(a, _REASONS).alias("reason"),
        _of(a, _RISKS).alias("risk"), F.round(cost, 6).alias("cost_impact"), F.round(green, 6).alias("green_impact"),
    )


def suggestion_windows(readings: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Contiguous periods of a site with the same action."""
    rows = within_days(readings.select("site_id", "timestamp", "id", action(t).alias("action")))
    same = Window.partitionBy("site_id", "day", "action").orderBy("timestamp", "id")
    rows = rows.withColumn("period", F.col("place") - F.row_number().over(same)).where("action <> 'none'")
    runs = rows.groupBy("action", "site_id", "day", "period").agg(*run_columns()).drop("period")
    return joined_days(runs, days_of(readings), "action").select("site_id", "action", "start_time", "end_time", "readings")


def energy_cost() -> Column:
    """An hour's import at its price."""
    return c("grid_import_kw") * c("electricity_price")


def discharge_saving(t: Thresholds = Thresholds()) -> Column:
    return F.when(_yes(price_is_high(t) & (c("battery_power_kw") > 0)), c("battery_power_kw") * c("electricity_price")).otherwise(0.0)


def charging_cost(t: Thresholds = Thresholds()) -> Column:
    return F.when(_yes(price_is_low(t) & (c("battery_power_kw") < 0)), F.abs("battery_power_kw") * c("electricity_price")).otherwise(0.0)


def site_day(readings: DataFrame) -> DataFrame:
    return readings.withColumn("day", F.to_date("timestamp"))


def daily_cost(readings: DataFrame) -> DataFrame:
    return site_day(readings).groupBy("site_id", "day").agg(F.round(F.sum(energy_cost()), 4).alias("energy_cost"), F.count("*").alias("readings"))


def daily_arbitrage(readings: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return site_day(readings).groupBy("site_id", "day").agg(F.round(F.sum(discharge_saving(t)), 4).alias("discharge_saving"), F.round(F.sum(charging_cost(t)), 4).alias("charging_cost"))


def before_after(readings: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Cost of a site's day as it was, and had the suggestions been followed, each at the power that the battery had.

    What it does already is not counted again: import moves by the difference to the suggested power, which is 0 for
    idle. Each reading stands for itself; ``battery_plan`` carries the charge through the day.
    """
    a = action(t)
    power = F.coalesce("battery_power_kw", F.lit(0.0))
    wanted = F.when(a == "discharge", F.abs(power)).when(a == "charge", -F.abs(power)).when(a == "idle", F.lit(0.0)).otherwise(power)
    shift = power - wanted
    after = F.greatest(c("grid_import_kw") + shift, F.lit(0.0)) * c("electricity_price")
    out = site_day(readings).groupBy("site_id", "day").agg(F.sum(energy_cost()).alias("x"), F.sum(after).alias("y"))
    return out.select("site_id", "day", F.round("x", 4).alias("cost_before"), F.round("y", 4).alias("cost_after"), F.round(F.col("x") - F.col("y"), 4).alias("saving"))


def _share(condition: Column) -> Column:
    """Share of readings, from whole counts, so that sums need no order."""
    return F.count_if(condition).cast("double") / F.count("*")


def second_life_bonus(t: Thresholds = Thresholds()) -> Column:
    return _yes(c("battery_is_second_life") & c("battery_health_status").isin("normal", "warning") & (c("battery_temperature") < t.temperature_high))


def green_index(readings: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Green operations index (0 to 100) of each site's day and its parts: 25, 25, 20, 20 and 10 points.

    The specification names penalties, not formulas. Ours: a part loses the share of readings with its penalties; the
    grid part also the share of load that was imported.
    """
    over = flag("OVER_CONTRACT_RISK", t)
    parts = site_day(readings).groupBy("site_id", "day").agg(
        (25.0 * (1.0 - _share(flag("PV_FORECAST_DEVIATION", t) | flag("GREEN_ENERGY_WASTE", t)))).alias("pv"),
        (25.0 * (1.0 - _share(flag("PEAK_PERIOD_ABNORMAL_CHARGING", t) | flag("BATTERY_SHOULD_DISCHARGE_BUT_DID_NOT", t) | flag("EMS_OR_EQUIPMENT_STATUS_WARNING", t)))).alias("operation"),
        (20.0 * (1.0 - F.least(F.lit(1.0), F.try_divide(F.sum("grid_import_kw"), F.sum("load_kw")))) * (1.0 - _share(over))).alias("grid"),
        (20.0 * (1.0 - _share(flag("BATTERY_HEALTH_RISK", t) | flag("LOW_SOC_RISK", t)))).alias("health"),
        (10.0 * _share(second_life_bonus(t))).alias("bonus"),
    )
    parts = parts.withColumn("grid", F.coalesce("grid", F.lit(0.0)))
    total = c("pv") + c("operation") + c("grid") + c("health") + c("bonus")
    names = ("pv", "operation", "grid", "health", "bonus")
    return parts.select("site_id", "day", *(F.round(n, 4).alias(f"{n}_points") for n in names), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 4).alias("green_index"))


def capacity_fade(readings: DataFrame) -> DataFrame:
    fade = F.lit(1.0) - F.try_divide(c("battery_available_capacity_kwh"), c("battery_rated_capacity_kwh"))
    return readings.groupBy("site_id").agg(F.round(F.min(fade), 6).alias("fade_low"), F.round(F.max(fade), 6).alias("fade_high"))
