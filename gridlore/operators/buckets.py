"""A table in buckets: a change writes the buckets that it touches, and nothing else.

Rows are dealt to buckets by a hash of their key. A pointer lists the folder of each bucket; a commit writes the touched
buckets to a new folder and then the next pointer, by one rename, which is the commit. Whatever fails before it leaves
the table as it was. The file system must rename atomically, as HDFS and local ones do and plain object stores do not;
only where it also refuses to rename onto a file that exists, as HDFS does, is a second writer at the same moment sure
to fail.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.operators import versions

#: Buckets of a new table: enough that a task can rewrite one.
BUCKETS = 64


def bucket_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _pointed(spark: SparkSession, table: str) -> dict | None:
    pointers = versions._pointers(spark, table)
    return json.loads(spark.read.option("wholetext", True).text(f"{table}/{pointers[-1]}").first()[0]) if pointers else None


def current(spark: SparkSession, table: str, schema, of: list[int] | None = None) -> DataFrame:
    """The committed rows, of all buckets or some; none before the first commit."""
    pointed = _pointed(spark, table)
    folders = [f"{table}/{f}" for b, f in pointed["folders"].items() if of is None or int(b) in of] if pointed else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def overlaid(rows: DataFrame, changes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``rows`` with those of ``changes`` in place of, and beside, their own."""
    return rows.join(changes.select(key), key, "left_anti").select(*rows.columns).unionByName(changes.select(*rows.columns))


def commit_changes(changes: DataFrame, table: str, key: str = "chunk_id", buckets: int = BUCKETS) -> list[int]:
    """Write new and changed rows, one for each key; the buckets written. No rows, no commit.

    The number of buckets is set by the table's first commit. A table has one writer at a time; a second one fails at
    the rename.
    """
    spark, schema = changes.sparkSession, changes.schema
    pointed = _pointed(spark, table) or {"buckets": buckets, "folders": {}}
    write = f"write-{uuid.uuid4().hex}"
    placed = changes.withColumn("__bucket", bucket_of(key, pointed["buckets"]))
    # Written at once: what the changes are computed from may be this very table, or cost calls.
    placed.write.option("compression", "zstd").parquet(f"{table}/.{write}")
    placed = spark.read.schema(placed.schema).parquet(f"{table}/.{write}")
    touched = sorted(r[0] for r in placed.select("__bucket").distinct().collect())  # at most one row for each bucket
    if touched:
        before = current(spark, table, schema, touched).withColumn("__bucket", bucket_of(key, pointed["buckets"]))
        rows = overlaid(before, placed, key).repartition(len(touched), "__bucket")
        rows.write.option("compression", "zstd").partitionBy("__bucket").parquet(f"{table}/{write}")
        pointed["folders"] |= {str(b): f"{write}/__bucket={b}" for b in touched}
        versions.point(spark, table, json.dumps(pointed))
    files, path = versions._fs(spark, f"{table}/.{write}")
    files.delete(path, True)
    return touched


def swept(spark: SparkSession, table: str) -> int:
    """Delete the folders that neither of the last two pointers lists; how many. Not while a commit is under way."""
    kept = set()
    for name in versions._pointers(spark, table)[-2:]:
        kept |= {f.partition("/")[0] for f in json.loads(spark.read.option("wholetext", True).text(f"{table}/{name}").first()[0])["folders"].values()}
    files, path = versions._fs(spark, table)
    old = [x.getPath() for x in files.listStatus(path) if x.isDirectory() and x.getPath().getName().lstrip(".").startswith("write-") and x.getPath().getName() not in kept]
    for folder in old:
        files.delete(folder, True)
    return len(old)
