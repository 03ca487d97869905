"""Anomaly rules: one boolean, one severity and one explanation for each reading.

Every condition on a null input is false, and the null inputs are listed. Functions of columns alone, so they hold for
batches and streams.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """All limits of the rules. Prices are absolute, or names of columns (see ``OWN_BANDS``)."""

    deviation: float = 0.20
    deviation_critical: float = 0.40
    contract: float = 0.90
    contract_critical: float = 1.00
    soc_low: float = 20.0
    soc_warning: float = 30.0
    temperature_high: float = 40.0
    temperature_warning: float = 35.0
    soh_low: float = 80.0
    soh_warning: float = 85.0
    price_high: float | str = 4.0
    price_low: float | str = 2.75
    soc_discharge: float = 30.0
    soc_full: float = 90.0
    soc_charge: float = 80.0
    load_increase: float = 0.20
    discharge_import: float = 0.80


@dataclass(frozen=True)
class Rule:
    name: str
    inputs: tuple[str, ...]
    flagged: Callable[[Thresholds], Column]
    severity: Callable[[Thresholds], Column]
    explanation: str


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _graded(critical: Column, warning: Column) -> Column:
    return F.when(_yes(critical), "critical").when(_yes(warning), "warning")


def _deviation(actual: str, expected: str) -> Column:
    return F.abs(F.col(actual) - F.col(expected)) / F.greatest(F.col(expected), F.lit(1.0))


c = F.col
#: Statuses and modes that need attention. Fixed values.
BAD_MODES = ("manual", "fallback", "error", "unknown")
BAD_STATUSES = ("warning", "fault", "error", "offline", "maintenance", "unknown")


def price_is_high(t: Thresholds) -> Column:
    return c("electricity_price") >= (c(t.price_high) if isinstance(t.price_high, str) else t.price_high)


def price_is_low(t: Thresholds) -> Column:
    return c("electricity_price") <= (c(t.price_low) if isinstance(t.price_low, str) else t.price_low)


def near_capacity(share: float) -> Column:
    return c("grid_import_kw") >= F.lit(share) * c("contract_capacity_kw")


RULES = {
    r.name: r
    for r in (
        Rule(
            "PV_FORECAST_DEVIATION", ("pv_actual_kw", "pv_forecast_kw"),
            lambda t: _deviation("pv_actual_kw", "pv_forecast_kw") >= t.deviation,
            lambda t: _graded(_deviation("pv_actual_kw", "pv_forecast_kw") >= t.deviation_critical, _deviation("pv_actual_kw", "pv_forecast_kw") >= t.deviation),
            "solar output differs from its forecast",
        ),
        Rule(
            "OVER_CONTRACT_RISK", ("grid_import_kw", "contract_capacity_kw"),
            lambda t: near_capacity(t.contract),
            lambda t: _graded(near_capacity(t.contract_critical), near_capacity(t.contract)),
            "grid import is near or over the contract capacity",
        ),
        Rule(
            "LOW_SOC_RISK", ("battery_soc",),
            lambda t: c("battery_soc") < t.soc_low,
            lambda t: _graded(c("battery_soc") < t.soc_low, c("battery_soc") < t.soc_warning),
            "battery charge is low",
        ),
        Rule(
            "BATTERY_HEALTH_RISK", ("battery_temperature", "battery_soh", "battery_health_status"),
            lambda t: _yes(c("battery_temperature") >= t.temperature_high) | _yes(c("battery_soh") < t.soh_low) | _yes(c("battery_health_status").isin("warning", "critical")),
            lambda t: _graded(
                _yes(c("battery_temperature") >= t.temperature_high) | _yes(c("battery_soh") < t.soh_low) | _yes(c("battery_health_status") == "critical"),
                _yes(c("battery_temperature") >= t.temperature_warning) | _yes(c("battery_soh") < t.soh_warning) | _yes(c("battery_health_status") == "warning"),
            ),
            "battery is hot, worn or reported unhealthy",
        ),
        Rule(
            "PEAK_PERIOD_ABNORMAL_CHARGING", ("electricity_price", "battery_power_kw"),
            lambda t: price_is_high(t) & (c("battery_power_kw") < 0),
            lambda t: F.when(_yes(price_is_high(t) & (c("battery_power_kw") < 0)), "warning"),
            "battery charges while the price is high",
        ),
        Rule(
            "BATTERY_SHOULD_DISCHARGE_BUT_DID_NOT", ("electricity_price", "grid_import_kw", "contract_capacity_kw", "battery_soc", "battery_power_kw"),
            lambda t: price_is_high(t) & near_capacity(t.contract) & (c("battery_soc") > t.soc_discharge) & (c("battery_power_kw") <= 0),
            lambda t: F.when(
                _yes(price_is_high(t) & near_capacity(t.contract) & (c("battery_soc") > t.soc_discharge) & (c("battery_power_kw") <= 0)),
                F.when(_yes(near_capacity(t.contract_critical)), "critical").otherwise("warning"),
            ),
            "price and grid import are high and the battery is charged, yet it does not discharge",
        ),
        Rule(
            "GREEN_ENERGY_WASTE", ("grid_export_kw", "battery_soc", "battery_power_kw"),
            lambda t: (c("grid_export_kw") > 0) & (c("battery_soc") < t.soc_full) & (c("battery_power_kw") >= 0),
            lambda t: F.when(_yes((c("grid_export_kw") > 0) & (c("battery_soc") < t.soc_full) & (c("battery_power_kw") >= 0)), "warning"),
            "energy is exported while the battery could store it",
        ),
        Rule(
            "EMS_OR_EQUIPMENT_STATUS_WARNING", ("ems_mode", "equipment_status"),
            lambda t: _yes(c("ems_mode").isin(*BAD_MODES)) | _yes(c("equipment_status").isin(*BAD_STATUSES)),
            lambda t: F.when(_yes(c("ems_mode").isin(*BAD_MODES)) | _yes(c("equipment_status").isin(*BAD_STATUSES)), "warning"),
            "management mode or equipment status needs attention",
        ),
        # Named by the specification without a formula; this one is ours.
        Rule(
            "ABNORMAL_LOAD_INCREASE", ("load_kw", "load_forecast_kw"),
            lambda t: (c("load_kw") - c("load_forecast_kw")) / F.greatest(c("load_forecast_kw"), F.lit(1.0)) >= t.load_increase,
            lambda t: F.when(_yes((c("load_kw") - c("load_forecast_kw")) / F.greatest(c("load_forecast_kw"), F.lit(1.0)) >= t.load_increase), "warning"),
            "load is far above its forecast",
        ),
    )
}


def flag(name: str, t: Thresholds = Thresholds()) -> Column:
    """Whether the rule holds; false on null inputs."""
    return _yes(RULES[name].flagged(t))


def insufficient_data(name: str) -> Column:
    """The rule's inputs that are null."""
    return F.array_compact(F.array(*(F.when(F.col(i).isNull(), F.lit(i)) for i in RULES[name].inputs)))


def evaluate(readings: DataFrame, name: str, t: Thresholds = Thresholds()) -> DataFrame:
    """``readings`` with flagged, severity, explanation and insufficient_data of one rule."""
    rule = RULES[name]
    return readings.withColumns(
        {"flagged": flag(name, t), "severity": rule.severity(t), "explanation": F.lit(rule.explanation), "insufficient_data": insufficient_data(name)}
    )


def anomalies(readings: DataFrame, t: Thresholds = Thresholds(), keys: tuple[str, ...] = ("id", "dataset_id", "site_id", "timestamp")) -> DataFrame:
    """One row for each rule that holds for a reading. One pass over the readings, no shuffle."""
    found = F.array(
        *(
            F.when(flag(n, t), F.struct(F.lit(n).alias("rule"), r.severity(t).alias("severity"), F.lit(r.explanation).alias("explanation")))
            for n, r in RULES.items()
        )
    )
    return readings.select(*keys, F.explode(F.array_compact(found)).alias("a")).select(*keys, "a.rule", "a.severity", "a.explanation")


#: Limits for readings that ``with_own_bands`` has given their dataset's prices.
OWN_BANDS = Thresholds(price_high="price_high", price_low="price_low")
#: Size of a sketch: its quartiles' ranks are within 0.5 % of all prices of theirs (99 % of the time).
SKETCH = 800


def price_sketches(readings: DataFrame) -> DataFrame:
    """dataset_id, day and a sketch of the day's prices (KLL), to be kept with the series and merged for any days."""
    rows = readings.where(F.col("electricity_price").isNotNull())
    return rows.groupBy("dataset_id", F.to_date("timestamp").alias("day")).agg(F.kll_sketch_agg_double("electricity_price", F.lit(SKETCH)).alias("sketch"))


def sketched_bands(sketches: DataFrame) -> DataFrame:
    """``price_bands`` from ``price_sketches``, without a look at the readings: quartiles of prices that occur."""
    merged = sketches.groupBy("dataset_id").agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return merged.select("dataset_id", at(0.75).alias("price_high"), at(0.25).alias("price_low"))


def with_own_bands(readings: DataFrame, bands: DataFrame) -> DataFrame:
    """Readings with their dataset's price_high and price_low, for rules and suggestions under ``OWN_BANDS``.

    A dataset without prices has none, and no price of it is high or low. A price that is both, where all are equal, is
    high and low at once.
    """
    return readings.join(bands.select("dataset_id", "price_high", "price_low"), "dataset_id", "left")


def price_bands(readings: DataFrame) -> DataFrame:
    """Each dataset's prices above which a price is high, and below which it is low (upper and lower quartile).

    Exact, between two prices where the quartile lies between them; ``sketched_bands`` is the way without another pass.
    Readings are counted by price before they are shuffled; null prices count for nothing.
    """
    price = "electricity_price"
    counts = readings.groupBy("dataset_id", price).agg(F.count(price).alias("n"))
    of = Window.partitionBy("dataset_id")
    up_to = F.sum("n").over(of.orderBy(price).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("dataset_id", price, up_to.alias("up_to"), F.sum("n").over(of).alias("total"))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    at = lambda k: F.min(F.when(F.col("up_to") > k, F.col(price)))
    ends = ((name, p, near, end) for name, p in (("high", 0.75), ("low", 0.25)) for near, end in ((F.floor, "a"), (F.ceil, "b")))
    found = placed.groupBy("dataset_id", "total").agg(*(at(near(place(p))).alias(f"{name}_{end}") for name, p, near, end in ends))
    between = lambda name, p: F.when(F.col(f"{name}_a") == F.col(f"{name}_b"), F.col(f"{name}_a")).otherwise((F.ceil(place(p)) - place(p)) * F.col(f"{name}_a") + (place(p) - F.floor(place(p))) * F.col(f"{name}_b"))
    return found.select("dataset_id", between("high", 0.75).alias("price_high"), between("low", 0.25).alias("price_low"))
