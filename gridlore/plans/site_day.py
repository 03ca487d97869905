"""Whole analyses of a site's day and of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.operators import rules, schedule, timeline
from gridlore.operators.rules import Thresholds
from gridlore.sources.documents import cases_in_series


def site_day_numbers(readings: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row for each site and day: readings, anomalies, suggestions, cost, and the green index."""
    flags = {n: rules.flag(n, t) for n in rules.RULES}
    critical = sum((F.coalesce(r.severity(t) == "critical", F.lit(False)) & flags[n]).cast("int") for n, r in rules.RULES.items())
    day = schedule.site_day(readings).withColumns({"flagged": sum(f.cast("int") for f in flags.values()), "critical": critical, "action": schedule.action(t)})
    numbers = day.groupBy("site_id", "day").agg(
        F.count("*").alias("readings"), F.sum("flagged").alias("anomalies"), F.sum("critical").alias("critical_anomalies"),
        *(F.count_if(F.col("action") == a).alias(f"{a}_suggestions") for a in ("charge", "discharge", "idle")),
        F.round(F.sum(schedule.energy_cost()), 4).alias("energy_cost"),
    )
    index = schedule.green_index(readings, t).select("site_id", "day", "green_index")
    return numbers.join(index, ["site_id", "day"])


def analyze_site_day(readings: DataFrame, site_id: str, day: str, t: Thresholds = Thresholds()) -> DataFrame:
    """One nested row: anomalies, recommendations, cost summary and green index of one site's day."""
    rows = readings.where((F.col("site_id") == site_id) & (F.to_date("timestamp") == F.lit(day).cast("date")))
    found = rules.anomalies(rows, t).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", "rule", "severity", "explanation"))).alias("anomalies"))
    advice = schedule.suggestion_windows(rows, t).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("start_time", "end_time", "action", "readings"))).alias("recommendations"))
    cost = schedule.before_after(rows, t).join(schedule.daily_arbitrage(rows, t), ["site_id", "day"])
    cost = cost.select("site_id", "day", F.struct("cost_before", "cost_after", "saving", "discharge_saving", "charging_cost").alias("cost_summary"))
    index = schedule.green_index(rows, t).select("site_id", F.col("green_index").alias("green_operations_index"))
    return cost.join(index, "site_id").join(found, "site_id", "left").join(advice, "site_id", "left").select(
        "site_id", F.col("day").alias("date"), "anomalies", "recommendations", "cost_summary", "green_operations_index"
    )


def report(readings: DataFrame, t: Thresholds = Thresholds(), cases: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sections of a dataset's report; with ``cases`` (as ``documents.read_cases`` gives them) also those of its datasets."""
    sections = {
        "summary": readings.groupBy("dataset_id").agg(F.count("*").alias("readings"), F.countDistinct("site_id").alias("sites"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time")),
        "anomalies": rules.anomalies(readings, t).groupBy("dataset_id", "rule", "severity").agg(F.count("*").alias("readings")),
        "timeline": timeline.periods(readings, t=t),
        "schedule": schedule.suggestion_windows(readings, t),
        "cost": schedule.before_after(readings, t),
        "green_index": schedule.green_index(readings, t),
        "limitations": readings.sparkSession.createDataFrame([("prices count as high or low by fixed limits",), ("an hourly grid is assumed: kW counts as kWh",), ("index parts follow formulas of this library",)], "limitation string"),
    }
    if cases is not None:
        met = cases_in_series(cases, readings).groupBy("case_id").agg(F.count("*").alias("readings"))
        own = cases.join(readings.select(F.col("dataset_id").alias("related_dataset_id")).distinct(), "related_dataset_id", "left_semi")
        own = own.join(met, "case_id", "left").withColumn("readings", F.coalesce("readings", F.lit(0)))
        sections["cases"] = own.select("related_dataset_id", "case_id", "event_type", "severity", "root_cause", "operator_action", "readings")
    return sections
