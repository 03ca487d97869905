"""Windows over readings: contiguous periods, trends, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.operators.rules import RULES, Thresholds, flag


def within_days(rows: DataFrame) -> DataFrame:
    """``rows`` with their day, their place in it by time and id, and how many rows of their site the day has.

    Days, not whole sites, are sorted; ``joined_days`` joins what touches at midnight.
    """
    day = Window.partitionBy("site_id", "day")
    rows = rows.withColumn("day", F.to_date("timestamp"))
    return rows.withColumn("place", F.row_number().over(day.orderBy("timestamp", "id"))).withColumn("of_day", F.count("*").over(day))


def joined_days(runs: DataFrame, days: DataFrame, state: str) -> DataFrame:
    """Periods from each day's own runs: state, site_id, start_time, end_time, readings.

    ``runs`` holds state, site_id, day, from_start and to_end (whether the run reaches the day's first and last reading),
    start_time, end_time and readings; ``days`` each (site_id, day) that has readings. A run that reaches the end of a day
    goes on with the one of the same state at the start of the site's next day with readings. Only runs at an edge, two
    a day and state at most, meet in one window.
    """
    out = [state, "site_id", "start_time", "end_time", "readings"]
    numbered = days.select(
        F.col("site_id").alias("site"), F.col("day").alias("date"), F.row_number().over(Window.partitionBy("site_id").orderBy("day")).alias("number")
    )
    edge = F.col("from_start") | F.col("to_end")
    at_edge = runs.where(edge).join(numbered, F.col("site_id").eqNullSafe(F.col("site")) & F.col("day").eqNullSafe(F.col("date")))
    order = Window.partitionBy(state, "site_id").orderBy("number", F.desc("from_start"))
    goes_on = F.col("from_start") & F.lag("to_end").over(order) & (F.lag("number").over(order) == F.col("number") - 1)
    parts = at_edge.withColumn("begins", F.when(goes_on, 0).otherwise(1)).withColumn("period", F.sum("begins").over(order))
    whole = parts.groupBy(state, "site_id", "period").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("readings").alias("readings"))
    return runs.where(~edge).select(*out).unionByName(whole.select(*out))


def run_columns() -> list[Column]:
    """Aggregates of a run of rows that ``within_days`` has placed."""
    return [
        (F.min("place") == 1).alias("from_start"),
        (F.max("place") == F.max("of_day")).alias("to_end"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.count("*").alias("readings"),
    ]


def days_of(readings: DataFrame) -> DataFrame:
    """Each (site_id, day) with readings."""
    return readings.select("site_id", F.to_date("timestamp").alias("day")).distinct()


def periods(readings: DataFrame, rules: list[str] | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Contiguous periods of a site during which a rule holds: rule, site_id, start, end, readings."""
    names = rules or list(RULES)
    placed = within_days(readings.select("site_id", "timestamp", "id", *(flag(n, t).cast("int").alias(n) for n in names)))
    # One window for all rules: a period's number is a reading's place less the holding readings so far.
    running = Window.partitionBy("site_id", "day").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    kept = ("site_id", "day", "timestamp", "place", "of_day")
    placed = placed.select(*kept, *names, *((F.col("place") - F.sum(n).over(running)).alias(f"{n}_period") for n in names))
    entries = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("holds"), F.col(f"{n}_period").alias("period")) for n in names))
    rows = placed.select(*kept, F.explode(entries).alias("e")).where("e.holds = 1")
    runs = rows.groupBy("e.rule", "site_id", "day", "e.period").agg(*run_columns()).drop("period")
    return joined_days(runs, days_of(readings), "rule")


def cycle_trend(readings: DataFrame, days: int = 7) -> DataFrame:
    """Each reading with the least and largest cycle count of its site over the days before it, the reading included.

    Whole hours in between count by their extremes; the hour at either edge by its readings, which are dealt by site and
    hour: each reading is also given to the hour for which it stands at the far edge.
    """
    reach, cycles = days * 24, F.col("battery_cycle_count")
    seconds = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    rows = readings.select("id", "site_id", "timestamp", cycles.alias("now"), F.lit(None).cast(readings.schema["battery_cycle_count"].dataType).alias("past"), seconds.alias("seconds"))
    hour = F.floor(F.col("seconds") / 3600)
    hours = rows.withColumn("hour", hour).groupBy("site_id", "hour").agg(F.min("now").alias("low"), F.max("now").alias("high"))
    # Hours without readings of their own need no row: only those of readings are asked for.
    between = Window.partitionBy("site_id").orderBy("hour").rangeBetween(1 - reach, -1)
    hours = hours.select(F.col("site_id").alias("site"), F.col("hour").alias("of"), F.min("low").over(between).alias("low"), F.max("high").over(between).alias("high"))
    gone = rows.select("id", "site_id", "timestamp", F.lit(None).cast(rows.schema["now"].dataType).alias("now"), F.col("now").alias("past"), (F.col("seconds") + reach * 3600).alias("seconds"))
    both = rows.withColumn("own", F.lit(True)).unionByName(gone.withColumn("own", F.lit(False))).withColumn("hour", hour)
    edge = Window.partitionBy("site_id", "hour")
    so_far = edge.orderBy("seconds").rangeBetween(Window.unboundedPreceding, 0)
    still = edge.orderBy(F.desc("seconds")).rangeBetween(Window.unboundedPreceding, 0)
    seen = both.select("id", "site_id", "timestamp", "hour", "own", *(f("now").over(so_far).alias(f"now_{n}") for f, n in ((F.min, "low"), (F.max, "high"))), *(f("past").over(still).alias(f"past_{n}") for f, n in ((F.min, "low"), (F.max, "high"))))
    met = seen.where("own").join(hours, F.col("site_id").eqNullSafe(F.col("site")) & (F.col("hour") == F.col("of")), "left")
    low, high = F.least("low", "now_low", "past_low"), F.greatest("high", "now_high", "past_high")
    return met.select("id", "site_id", "timestamp", low.alias("cycles_low"), high.alias("cycles_high"), (high - low).alias("cycles_spread"))


def load_peaks(readings: DataFrame, k: int = 5) -> DataFrame:
    """The k readings of largest load of each site and day; ties to the smaller id."""
    order = Window.partitionBy("site_id", F.to_date("timestamp")).orderBy(F.desc_nulls_last("load_kw"), "id")
    return readings.withColumn("peak_rank", F.row_number().over(order)).where(F.col("peak_rank") <= k).select("site_id", F.to_date("timestamp").alias("day"), "peak_rank", "id", "load_kw")
