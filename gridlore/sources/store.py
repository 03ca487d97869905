"""Datasets on Parquet: the catalogue, the series, and the read functions over them.

A store is a folder with ``datasets``, ``series`` and ``warnings`` (both partitioned by dataset). Data is written first and the catalogue
row last, so a failed write is never seen.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.operators.intervals import running_total
from gridlore.schemas import DATASETS, ENERGY_COLUMNS, SERIES, SUMMARY_COLUMNS, WARNING
from gridlore.sources import energy_csv

MOST_ROWS = 1000


class DatasetNotFound(LookupError):
    """No dataset has this id."""


@dataclass
class IngestResult:
    dataset_id: int | None
    row_count: int
    inserted_count: int
    status: str
    #: The first of them; all are in the store (``warnings``).
    warnings: list[dict] = field(default_factory=list)
    warning_count: int = 0


def health(spark: SparkSession) -> dict:
    """Whether a query runs, and the version that runs it; an error is part of the answer."""
    try:
        return {"status": "ok" if spark.range(1).count() == 1 else "error", "spark": spark.version}
    except Exception as e:  # the probe reports any failure
        return {"status": "error", "spark": spark.version, "error": str(e)}


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not path_.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path_):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def datasets(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/datasets", DATASETS)


def series(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/series", SERIES)


def warnings(spark: SparkSession, store: str, dataset_id: int) -> DataFrame:
    """All warnings of an upload, in the order of the checks, then of the rows; missing columns first."""
    rows = _read(spark, f"{store}/warnings", T.StructType([T.StructField("place", T.LongType()), *WARNING.fields, T.StructField("dataset_id", T.LongType())]))
    return rows.where(F.col("dataset_id") == dataset_id).orderBy("place", F.asc_nulls_first("row")).select(*WARNING.fieldNames())


def listed(catalogue: DataFrame) -> DataFrame:
    """Newest first; a null creation time counts as newest."""
    return catalogue.select(*DATASETS.fieldNames()).orderBy(F.desc_nulls_first("created_at"), F.desc("id"))


def list_datasets(spark: SparkSession, store: str) -> DataFrame:
    return listed(datasets(spark, store))


def get_dataset(spark: SparkSession, store: str, dataset_id: int) -> dict:
    found = datasets(spark, store).where(F.col("id") == dataset_id).head(1)
    if not found:
        raise DatasetNotFound(dataset_id)
    return found[0].asDict()


def summary_of(rows: DataFrame, dataset_id: int) -> DataFrame:
    """One row: counts, extent, and least, mean and largest value of each numeric column; one scan. Nulls for no rows."""
    columns = [c for c in SUMMARY_COLUMNS if c in rows.columns]
    stats = [F.struct(F.min(c).cast("double").alias("min"), F.avg(c).alias("mean"), F.max(c).cast("double").alias("max")).alias(c) for c in columns]
    out = rows.where(F.col("dataset_id") == dataset_id).agg(
        F.count("*").alias("row_count"), F.countDistinct("site_id").alias("site_count"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), *stats
    )
    named = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))
    return out.select(F.lit(dataset_id).cast("long").alias("dataset_id"), "row_count", "site_count", "start_time", "end_time", named.alias("columns"))


def dataset_summary(spark: SparkSession, store: str, dataset_id: int) -> DataFrame:
    get_dataset(spark, store, dataset_id)
    return summary_of(series(spark, store), dataset_id)


def page_of(rows: DataFrame, dataset_id: int, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a dataset's rows in time order, nulls last."""
    for name, value, low, high in (("limit", limit, 1, MOST_ROWS), ("offset", offset, 0, None)):
        if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
            raise ValueError(f"{name} must be a whole number from {low}" + (f" to {high}" if high else ""))
    return rows.where(F.col("dataset_id") == dataset_id).orderBy(F.asc_nulls_last("timestamp"), F.asc("id")).offset(offset).limit(limit)


def timeseries_page(spark: SparkSession, store: str, dataset_id: int, limit: int = 100, offset: int = 0) -> tuple[int, DataFrame]:
    """Total of the dataset's rows, and one page of them."""
    get_dataset(spark, store, dataset_id)
    rows = series(spark, store)
    page = page_of(rows, dataset_id, limit, offset)
    return rows.where(F.col("dataset_id") == dataset_id).count(), page


def ingest_csv(spark: SparkSession, store: str, path: str, name: str | None = None, description: str | None = None, clock=None) -> IngestResult:
    """Validate a CSV file and append it as a new dataset; a refused or failed upload is a result, too.

    Ids are the largest known plus one, so a store has one writer at a time.
    """
    file_name = path.rstrip("/").rpartition("/")[2]
    try:
        rows, missing = energy_csv.validate(energy_csv.read_csv(spark, path))
    except energy_csv.IngestionError as e:
        return IngestResult(None, 0, 0, "failed", [{"row": None, "column": None, "issue": str(e), "action": "upload rejected"}])
    rows = rows.cache()  # read by three actions below
    try:
        found = energy_csv.warnings_of(rows, missing)
        shown = [r.asDict() for r in found.orderBy("place", F.asc_nulls_first("row")).limit(MOST_ROWS).drop("place").collect()]
        count = len(missing) + (rows.agg(F.sum(F.size("warnings"))).first()[0] or 0)
        kept = energy_csv.accepted(rows)
        extent = rows.agg(F.count("*").alias("n"), F.count("timestamp").alias("kept"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
        taken = series(spark, store).agg(F.max("id"), F.max("dataset_id")).first()
        base = taken[0] or 0
        # Rows of an upload that failed before its catalogue row was written keep their dataset's id to themselves.
        dataset_id = max(datasets(spark, store).agg(F.max("id")).first()[0] or 0, taken[1] or 0) + 1
        numbered = running_total(kept.withColumn("__file", F.lit(0)), "__file", "row", F.lit(1), "__before")
        numbered = numbered.select((F.col("__before") + 1 + base).alias("id"), F.lit(dataset_id).cast("long").alias("dataset_id"), *ENERGY_COLUMNS)
        numbered.write.mode("append").partitionBy("dataset_id").parquet(f"{store}/series")
        found.withColumn("dataset_id", F.lit(dataset_id).cast("long")).write.mode("append").partitionBy("dataset_id").parquet(f"{store}/warnings")
        now = (clock or (lambda: datetime.datetime.now(datetime.timezone.utc)))()
        row = (dataset_id, name or file_name, file_name, description, extent["kept"], extent["a"], extent["b"], now)
        spark.createDataFrame([row], DATASETS).write.mode("append").parquet(f"{store}/datasets")
        return IngestResult(dataset_id, extent["n"], extent["kept"], "success_with_warnings" if count else "success", shown, count)
    except Exception as e:  # a failed write leaves no catalogue row and is reported as a result
        return IngestResult(None, 0, 0, "failed", [{"row": None, "column": None, "issue": str(e), "action": "upload failed"}])
    finally:
        rows.unpersist()
