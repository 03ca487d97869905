"""Findings met with their evidence: rules' results, cases and passages in answers of seven parts.

Only the structure is built. ``background``, general knowledge that a writer may add, is kept apart and stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.operators.rules import RULES

#: Cases, causes, actions and passages named in an answer, at most; all are counted.
NAMED = 5
PASSAGES = "array<struct<rank:int,chunk_id:string,filename:string,page_index_start:int,page_index_end:int>>"


def findings(anomalies: DataFrame) -> DataFrame:
    """Each rule that holds on a site's day of a dataset: readings, first and last time, explanation."""
    by_day = anomalies.groupBy("dataset_id", "site_id", F.to_date("timestamp").alias("day"), "rule")
    return by_day.agg(F.count("*").alias("readings"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.min("explanation").alias("explanation"))


def _frequent(cases: DataFrame, column: str, name: str) -> DataFrame:
    """rule, name: the most frequent values of a column among a rule's cases, with their counts; ties by value."""
    counts = cases.where(F.col(column).isNotNull()).groupBy("rule", F.col(column).alias("value")).agg(F.count("*").alias("cases"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("cases"), "value"))).where(F.col("rank") <= NAMED)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "cases"))), lambda x: F.struct(x["value"].alias("value"), x["cases"].alias("cases")))
    return ranked.groupBy("rule").agg(listed.alias(name))


def case_evidence(cases: DataFrame) -> DataFrame:
    """By rule (a case's ``event_type``): how many cases, the least ids of them, frequent causes and actions.

    One row for each of the fixed rules at most; other kinds of case are no evidence here. Counts and first ids are taken
    before rows are shuffled, so that one kind may hold any share of the cases.
    """
    kind = cases.withColumn("rule", F.col("event_type")).where(F.col("rule").isin(list(RULES)))
    counted = kind.groupBy("rule").agg(F.count("*").alias("cases"))
    least = kind.select("rule", "case_id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("rule").orderBy("case_id")))
    ids = least.where(F.col("rank") <= NAMED).groupBy("rule").agg(F.array_sort(F.collect_list("case_id")).alias("case_ids"))
    out = counted.join(ids, "rule", "left")
    return out.join(_frequent(kind, "root_cause", "causes"), "rule", "left").join(_frequent(kind, "operator_action", "actions"), "rule", "left")


def passage_evidence(hits: DataFrame) -> DataFrame:
    """By rule, the passages of least rank, one row for each of the fixed rules at most. hits: rule, rank, chunk_id, filename, page_index_start, page_index_end."""
    best = hits.where((F.col("rank") <= NAMED) & F.col("rule").isin(list(RULES)))
    page = F.struct("rank", "chunk_id", "filename", "page_index_start", "page_index_end")
    return best.groupBy("rule").agg(F.slice(F.array_sort(F.collect_list(page)), 1, NAMED).alias("passages"))


def answers(found: DataFrame, cases: DataFrame, hits: DataFrame | None = None, enough: tuple[int, int] = (1, 2)) -> DataFrame:
    """One answer for each row of ``findings``: finding, evidence, possible_causes, background, next_checks, confidence, citations.

    Causes are hypotheses with the number of cases that name them. Confidence counts the cases and passages beside the
    readings themselves: without cases and passages it is ``insufficient data``, with fewer than ``enough[0]`` of either
    ``low``, with fewer than ``enough[1]`` ``medium``, else ``high``; the limits are ours. Every citation names an
    internal source by type. Evidence has one row for each rule, so it is joined without moving the findings.
    """
    met = found.join(F.broadcast(case_evidence(cases)), "rule", "left")
    none = F.array().cast(PASSAGES)
    if hits is None:
        met = met.withColumn("passages", none)
    else:
        met = met.join(F.broadcast(passage_evidence(hits)), "rule", "left").withColumn("passages", F.coalesce(F.col("passages").cast(PASSAGES), none))
    n_cases, n_passages = F.coalesce("cases", F.lit(0)), F.size("passages")
    kinds = (n_cases > 0).cast("int") + (n_passages > 0).cast("int")
    least = F.least(n_cases, n_passages)
    confidence = F.when(kinds == 0, "insufficient data").when(least < enough[0], "low").when(least < enough[1], "medium").otherwise("high")
    cited = lambda kind, ref: F.struct(F.lit("internal").alias("kind"), F.lit(kind).alias("source"), ref.alias("reference"))
    pages = lambda p: F.concat(p["filename"], F.lit(" p. "), p["page_index_start"].cast("string"), F.lit("-"), p["page_index_end"].cast("string"))
    citations = F.concat(
        F.array(cited("dataset", F.col("dataset_id").cast("string"))),
        F.transform(F.coalesce(F.col("case_ids").cast("array<string>"), F.array().cast("array<string>")), lambda i: cited("case", i)),
        F.transform("passages", lambda p: cited("document", pages(p))),
    )
    return met.select(
        "dataset_id", "site_id", "day", "rule", F.struct("readings", "start_time", "end_time", "explanation").alias("finding"),
        F.struct(n_cases.alias("cases"), n_passages.alias("passages")).alias("evidence"), F.col("causes").alias("possible_causes"),
        F.lit(None).cast("string").alias("background"), F.col("actions").alias("next_checks"), confidence.alias("confidence"), citations.alias("citations"),
    )
