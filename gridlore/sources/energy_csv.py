"""CSV ingestion: typed rows, and a warning for each value that was repaired or refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions.text import normalised, trimmed
from gridlore.schemas import BASIC_COLUMNS, EMS_MODES, ENERGY_COLUMNS, EQUIPMENT_STATUSES, FLOAT_COLUMNS, HEALTH_STATUSES, REQUIRED_COLUMNS

# Cells that count as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Spellings of booleans.
TRUE, FALSE = ["true", "1", "yes"], ["false", "0", "no"]
#: Formats of a timestamp, each row by itself.
TIMESTAMP_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd"]
STRING_COLUMNS = ["site_id", "weather_condition"]
ENUMS = {"battery_health_status": HEALTH_STATUSES, "ems_mode": EMS_MODES, "equipment_status": EQUIPMENT_STATUSES}


class IngestionError(ValueError):
    """The upload as a whole is refused."""


def present(c: Column) -> Column:
    """Null for cells that count as missing."""
    return F.when(~c.isin(MISSING), c)


def to_number(c: Column) -> Column:
    """A finite number, else null."""
    x = F.trim(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_timestamp(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)).cast("timestamp_ntz") for f in TIMESTAMP_FORMATS))


def to_boolean(c: Column) -> Column:
    word = normalised(c)
    return F.when(word.isin(TRUE), F.lit(True)).when(word.isin(FALSE), F.lit(False))


def to_enum(c: Column, allowed: list[str]) -> Column:
    word = normalised(c)
    return F.when(word.isNotNull() & ~word.isin(allowed), "unknown").otherwise(word)


def _warn(when: Column, column: str, issue: Column | str, action: str) -> Column:
    issue = F.lit(issue) if isinstance(issue, str) else issue
    return F.when(when, F.struct(F.col("row"), F.lit(column).alias("column"), issue.alias("issue"), F.lit(action).alias("action")))


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


def validate(raw: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Typed rows with their warnings, from all-string columns and ``row``, each cell's line in the file.

    Returns the rows (row, energy columns, warnings) and the columns that are missing. A row whose timestamp cannot be
    read keeps that one warning and a null timestamp; the caller drops it. One projection, no shuffle.
    """
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    missing = [c for c in REQUIRED_COLUMNS if c not in raw.columns]
    if missing:
        raise IngestionError(f"missing required columns: {', '.join(sorted(missing))}")
    if not any(c in raw.columns for group in BASIC_COLUMNS.values() for c in group):
        raise IngestionError("at least one PV, load, battery or price column is required")
    absent = [c for c in ENERGY_COLUMNS if c not in raw.columns]
    source = {c: F.lit(None).cast("string") if c in absent else present(F.col(c)) for c in ENERGY_COLUMNS}
    # Stage by stage, so that each later check sees the values that the earlier ones have left.
    cells = raw.select("row", *(source[c].alias(c) for c in ENERGY_COLUMNS))
    typed: dict[str, Column] = {"timestamp": to_timestamp(F.col("timestamp"))}
    checks = [_warn(typed["timestamp"].isNull(), "timestamp", F.concat(F.lit("could not parse timestamp value '"), F.coalesce(F.col("timestamp"), F.lit("nan")), F.lit("'")), "row skipped")]
    unread = lambda c: F.concat(F.lit("could not convert value '"), F.col(c), F.lit("' to numeric"))
    for c in [*FLOAT_COLUMNS, "battery_cycle_count"]:
        typed[c] = to_number(F.col(c))
        checks.append(_warn(F.col(c).isNotNull() & typed[c].isNull(), c, unread(c), "stored as NULL"))
    typed["battery_cycle_count"] = F.bround(typed["battery_cycle_count"], 0).try_cast("int")
    for c in ("battery_soc", "battery_soh"):
        off = (typed[c] < 0) | (typed[c] > 100)
        checks.append(_warn(off, c, F.concat(F.lit("value "), typed[c].cast("string"), F.lit(" out of expected range 0-100")), "kept as-is"))
    for c, allowed in ENUMS.items():
        word = normalised(F.col(c))
        issue = F.concat(F.lit("invalid value '"), word, F.lit(f"', expected one of {_listed(allowed)}"))
        checks.append(_warn(word.isNotNull() & ~word.isin(allowed), c, issue, "stored as 'unknown'"))
        typed[c] = to_enum(F.col(c), allowed)
    typed["battery_is_second_life"] = to_boolean(F.col("battery_is_second_life"))
    checks.append(_warn(F.col("battery_is_second_life").isNotNull() & typed["battery_is_second_life"].isNull(), "battery_is_second_life", "invalid boolean value, expected true or false", "stored as NULL"))
    for c in STRING_COLUMNS:
        typed[c] = trimmed(F.col(c))
    # A skipped row has no warning but that of its timestamp.
    numbered = [F.when(F.lit(k == 0) | typed["timestamp"].isNotNull(), F.when(w.isNotNull(), F.struct(F.lit(k).alias("check"), w.alias("w")))) for k, w in enumerate(checks)]
    rows = cells.select("row", *(typed[c].alias(c) for c in ENERGY_COLUMNS), F.array_compact(F.array(*numbered)).alias("warnings"))
    return rows, [(c, "column missing from file") for c in absent]


def _feeds_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line has a quote that it does not close."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file's cells as strings, with ``row``: the line in the file, where the header is line 1 and blank lines do not count.

    A file is one upload. Its splits are read in parallel; a split's rows are numbered from the rows of those before it,
    which one pass counts. Only a file with line feeds in quotes is read in one task.
    """
    header = spark.read.option("header", True).option("multiLine", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    reader = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").schema(schema)
    if _feeds_in_quotes(spark, path):
        rows = reader.option("multiLine", True).csv(path).coalesce(1)
        return rows.withColumn("row", (F.monotonically_increasing_id() + 2).cast("int"))
    # Ids grow by one from row to row of a split.
    rows = reader.csv(path).select("*", F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"))
    splits = rows.groupBy("__split").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each split
    splits = splits.select("__split", (before - F.col("__first") + 2).alias("__shift"))
    numbered = rows.join(F.broadcast(splits), "__split")
    return numbered.select(*(F.col(f"`{c}`") for c in header), (F.col("__at") + F.col("__shift")).cast("int").alias("row"))


def warnings_of(rows: DataFrame, missing: list[tuple[str, str]]) -> DataFrame:
    """Warnings (place, row, column, issue, action); by place, then row, they are in the order of the checks, missing columns first."""
    spark = rows.sparkSession
    each = rows.select(F.explode("warnings").alias("x")).select("x.check", "x.w.row", "x.w.column", "x.w.issue", "x.w.action")
    first = spark.createDataFrame([(k - len(missing), None, c, i, "stored as NULL") for k, (c, i) in enumerate(missing)], "check int, row int, column string, issue string, action string")
    return first.unionByName(each).select(F.col("check").cast("long").alias("place"), "row", "column", "issue", "action")


def accepted(rows: DataFrame) -> DataFrame:
    """Rows whose timestamp was read, in the stored columns."""
    return rows.where(F.col("timestamp").isNotNull()).select("row", *ENERGY_COLUMNS)
