"""Shared pieces: staged tables, Arrow text access, word spans and word hashes."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

_U = np.uint64


#: Frees the shuffle files of a query as soon as it has ended; staged queries never run twice.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a new local folder if Spark runs in one process (tests), else an error: executors of a cluster
    would not see each other's files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.gridlore.shared", "")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gridlore-")
        spark.conf.set("spark.gridlore.shared", base)
    return f"{base.rstrip('/')}/gridlore"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and a lost executor costs no rerun.

    Its shuffle files go when it is written; the table stays until ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables. Only for those whose every reader has been written itself."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.staged_at
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get 1,000 rows at once, where the session has Spark's default of 10,000: whole texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def free_name(table: DataFrame, name: str) -> str:
    """``name``, with underscores after it as long as the table has such a column."""
    while name.lower() in {c.lower() for c in table.columns}:
        name += "_"
    return name


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# ---------------------------------------------------------------- Arrow text


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or data is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts make up at most ``most`` bytes (or a single row)."""
    _, at = utf8(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def kept_rows(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs``, in all its columns, for which ``keep(texts)`` is true; it gets the column ``text``, as Arrow."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


# --------------------------------------------------------------------- words

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes are hashed one by one.
_LONG_WORD = 256
def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h = h * _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def words(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, and the word offsets of each text (n + 1).

    ``lower`` makes A-Z count as a-z.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_WHITE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = _word_hashes(_LOWER[data] if lower else data, start, end - start)
    return start, end, hashes, np.searchsorted(start, at)


def _word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; long words by a cryptographic digest."""
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, 0, (1,))
    h = mix(size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    rows = slice(None)  # those with bytes left
    at, left = start, size
    while len(at):
        short = (_U(8) * (_U(8) - np.minimum(left, 8).astype(np.uint64)))
        h[rows] = mix(h[rows] ^ (eights[at] << short))
        go_on = np.flatnonzero((left > 8) & (left <= _LONG_WORD))
        rows = go_on if isinstance(rows, slice) else rows[go_on]
        at, left = at[go_on] + 8, left[go_on] - 8
    for k in np.flatnonzero(size > _LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : start[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes; runs across two texts are the caller's to leave out."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:m].copy()
    for k in range(1, width):
        total *= _U(0xD6E8FEB86659FD93)
        total += hashes[k : k + m]
    return mix(total + _U(width))


def grams_at(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """As ``grams``, of the runs that begin at these places alone."""
    total = hashes[at]
    for k in range(1, width):
        total *= _U(0xD6E8FEB86659FD93)
        total += hashes[at + k]
    return mix(total + _U(width))
