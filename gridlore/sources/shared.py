"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Frees the shuffle files of a query as soon as it has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, or below a local folder where that is unset and Spark runs in one process.

    On a cluster an unset folder is an error: executors would not see each other's files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.gridlore.folder", "")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gridlore-")
        spark.conf.set("spark.gridlore.folder", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again; its shuffle files go when it is written."""
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables whose readers have all been written themselves."""
    for table in tables:
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
