"""The cheapest day that a battery can follow: charge carried from hour to hour, planned by a dynamic programme."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOURS = 24


@dataclass(frozen=True)
class Battery:
    """Steps of charge from empty to full, bounds of the charge in percent, and the greatest power as a share of capacity.

    ``capacity_kwh`` and ``charge`` stand in where readings have none. Losses are not counted.
    """

    levels: int = 20
    low: float = 20.0
    high: float = 100.0
    power: float = 0.5
    capacity_kwh: float = 100.0
    charge: float = 50.0


def hourly_loads(readings: DataFrame, b: Battery = Battery()) -> DataFrame:
    """One row for each site and day: its hours in order (import, power, price), first charge and capacity.

    Hours are means of their readings; those without import or price are left out. 24 entries a day at most.
    """
    hour = F.hour("timestamp").alias("hour")
    rows = readings.where(F.col("timestamp").isNotNull()).withColumns({"day": F.to_date("timestamp"), "hour": hour})
    mean = lambda c: F.avg(c).alias(c)
    first = F.min_by("battery_soc", F.when(F.col("battery_soc").isNotNull(), F.struct("timestamp", "id"))).alias("soc")
    began = F.min(F.when(F.col("battery_soc").isNotNull(), F.struct("timestamp", "id"))).alias("began")
    hours = rows.groupBy("site_id", "day", "hour").agg(mean("grid_import_kw"), mean("battery_power_kw"), mean("electricity_price"), F.max("battery_available_capacity_kwh").alias("capacity"), first, began)
    known = F.col("grid_import_kw").isNotNull() & F.col("electricity_price").isNotNull()
    entry = F.struct("hour", F.col("grid_import_kw").alias("bought"), F.coalesce("battery_power_kw", F.lit(0.0)).alias("power"), F.col("electricity_price").alias("price"))
    return hours.groupBy("site_id", "day").agg(
        F.array_sort(F.collect_list(F.when(known, entry))).alias("hours"),
        F.coalesce(F.min_by("soc", F.col("began")), F.lit(b.charge)).alias("charge"), F.coalesce(F.max("capacity"), F.lit(b.capacity_kwh)).alias("capacity"),
    )


def plan(needed: np.ndarray, price: np.ndarray, known: np.ndarray, level: np.ndarray, step: np.ndarray, b: Battery) -> tuple[np.ndarray, np.ndarray]:
    """Moves and cost of the cheapest plan of each day: how many levels each hour discharges (less than 0: charges).

    needed, price: (day, hour) of what is used without the battery; known: the hours in which the battery may move;
    level, step: first level and kWh of a level of each day. Charge stays within its bounds (or, from outside, goes no further out), and ends no lower than it began. Of
    equal plans the one that discharges least at each hour, from the first on.
    """
    days, hours = needed.shape
    at = np.arange(b.levels + 1)
    # A day may stay where it began, whatever the bounds.
    floor = np.minimum(level, int(np.ceil(b.low / 100 * b.levels - 1e-9)))
    roof = np.maximum(level, int(np.floor(b.high / 100 * b.levels + 1e-9)))
    allowed = (at >= floor[:, None]) & (at <= roof[:, None])
    most = int(np.floor(b.power * b.levels + 1e-9))
    moves = np.arange(-most, most + 1)
    value = np.where(allowed & (at >= level[:, None]), 0.0, np.inf)
    choice = np.zeros((hours, days, b.levels + 1), np.int16)
    for h in reversed(range(hours)):
        best = np.full(value.shape, np.inf)
        for k, m in enumerate(moves):
            low, high = max(0, m), min(b.levels, b.levels + m)  # levels from which the move stays on the scale
            cost = price[:, h] * np.maximum(needed[:, h] - m * step, 0.0)
            total = np.full(value.shape, np.inf)
            total[:, low : high + 1] = cost[:, None] + value[:, low - m : high - m + 1]
            if m:
                total[~known[:, h]] = np.inf
            better = total < best - 1e-9
            best = np.where(better, total, best)
            choice[h][better] = k
        value = np.where(allowed, best, np.inf)
    made, now = np.zeros((days, hours), np.int64), level.copy()
    every = np.arange(days)
    for h in range(hours):
        made[:, h] = moves[choice[h][every, now]]
        now = now - made[:, h]
    return made, value[every, level]


PLAN = "site_id string, day date, cost_before double, cost_planned double, saving double, charge_first double, charge_last double, plan array<struct<hour: int, power_kw: double, charge: double>>"


def battery_plans(readings: DataFrame, b: Battery = Battery()) -> DataFrame:
    """The cheapest plan of each site's day against the day as it was, see ``PLAN``.

    What a site used is its import and what its battery gave; the plan buys the rest. ``power_kw`` above 0 discharges,
    ``charge`` is that after the hour, in percent. The saving is 0 where the day was no dearer than the plan, as it is
    if it followed it. Days without a usable hour have an empty plan and cost nothing. One row for each site's day is
    planned by itself, many at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bought, power, price = (np.zeros((n, HOURS)) for _ in range(3))
            listed = batch.column(2).to_pylist()
            for k, hours in enumerate(listed):
                for h in hours:
                    bought[k, h["hour"]], power[k, h["hour"]], price[k, h["hour"]] = h["bought"], h["power"], h["price"]
            charge, capacity = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (3, 4))
            step = capacity / b.levels
            level = np.clip(np.floor(charge / 100 * b.levels + 1e-9).astype(np.int64), 0, b.levels)
            used = np.zeros((n, HOURS), bool)
            for k, hours in enumerate(listed):
                used[k, [h["hour"] for h in hours]] = True
            moves, cost = plan(np.maximum(bought + power, 0.0), price, used, level, step, b)
            before = (bought * price).sum(1)
            after = level[:, None] - np.cumsum(moves, axis=1)
            plans = [[{"hour": h["hour"], "power_kw": float(moves[k, h["hour"]] * step[k]), "charge": 100.0 * after[k, h["hour"]] / b.levels} for h in hours] for k, hours in enumerate(listed)]
            kind = pa.list_(pa.struct([("hour", pa.int32()), ("power_kw", pa.float64()), ("charge", pa.float64())]))
            columns = [batch.column(0), batch.column(1), pa.array(before), pa.array(cost), pa.array(np.maximum(before - cost, 0.0))]
            columns += [pa.array(100.0 * level / b.levels), pa.array(100.0 * after[:, -1] / b.levels), pa.array(plans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in "site_id,day,cost_before,cost_planned,saving,charge_first,charge_last,plan".split(",")])

    return hourly_loads(readings, b).mapInArrow(run, PLAN)
