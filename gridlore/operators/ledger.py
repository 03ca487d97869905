"""A ledger of embedding calls: what a provider has been paid for is read from then on.

Texts are known by their content hash. Those that the ledger lacks are dealt to slots, each of which one task works
through in the order of its hashes. A call that has come back is written to the ledger by the task itself, before the
next one is made; a task that starts again reads what its slot has and goes on behind it. So a lost executor costs at
most the call that was under way, and a later run of any kind costs nothing for the same texts, model and version.

A ledger is a folder that the driver and all executors share; calls become part of it by one rename. Spark should not
run tasks twice for speed (``spark.speculation``), which would pay twice, too.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of a call.
BATCH = 96
#: Calls of a slot, about.
SLOT_CALLS = 16
TRIES = 3
TOKENS = ("prompt_tokens", "total_tokens")
#: Tries and tokens of a call stand at its first text.
ENTRIES = "content_hash string, embedding array<float>, error string, run string, slot int, call string, calls int, prompt_tokens long, total_tokens long"
_ENTRIES = pa.schema(
    [("content_hash", pa.string()), ("embedding", pa.list_(pa.float32())), ("error", pa.string()), ("run", pa.string()), ("slot", pa.int32())]
    + [("call", pa.string()), ("calls", pa.int32()), ("prompt_tokens", pa.int64()), ("total_tokens", pa.int64())]
)


class EmbeddingError(RuntimeError):
    """The provider failed on every try."""


class EmbeddingProvider(Protocol):
    """Turns texts into vectors; runs in the workers.

    A provider may also have ``usage``, a dict with ``prompt_tokens`` and ``total_tokens`` of its last call (either may be
    missing or None).
    """

    name: str
    model: str
    version: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def folder_of(ledger: str, provider: EmbeddingProvider) -> str:
    """The part of a ledger that holds the calls to this model and version."""
    key = json.dumps([provider.name, provider.model, provider.version])
    return f"{ledger.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


class _Slot:
    """What a task has of its slot in this run, and the way to add to it."""

    def __init__(self, folder: str, run: str, slot: int):
        self.files, self.folder = _files(folder)
        self.run, self.slot, self.name = run, slot, f"{run}-{slot:08}"
        listed = self.files.get_file_info(fs.FileSelector(self.folder))
        self.calls = sorted(x.path for x in listed if x.base_name.startswith(f"call-{self.name}-"))
        self.done: set[str] = set()
        for path in [*self.calls, *(x.path for x in listed if x.base_name == f"slot-{self.name}.parquet")]:
            self.done |= set(pq.read_table(path, columns=["content_hash"], filesystem=self.files).column(0).to_pylist())

    def _write(self, table: pa.Table, name: str) -> str:
        hidden, path = f"{self.folder}/.{uuid.uuid4().hex}", f"{self.folder}/{name}.parquet"
        pq.write_table(table, hidden, filesystem=self.files)
        self.files.move(hidden, path)
        return path

    def add(self, hashes: list[str], vectors: list, error: str | None, tries: int, used: dict) -> None:
        n, call = len(hashes), uuid.uuid4().hex
        at_first = lambda x: [x, *[None] * (n - 1)]
        columns = [hashes, vectors, [error] * n, [self.run] * n, [self.slot] * n, [call] * n, at_first(tries), *(at_first(used.get(t)) for t in TOKENS)]
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, _ENTRIES, strict=True)], schema=_ENTRIES)
        self.calls.append(self._write(table, f"call-{self.name}-{call}"))

    def close(self) -> None:
        """One file for the slot instead of one for each call; until the latter are gone, a reader may meet both."""
        if len(self.calls) > 1:
            self._write(pa.concat_tables(pq.read_table(p, filesystem=self.files) for p in self.calls), f"slot-{self.name}")
            for path in self.calls:
                self.files.delete_file(path)


def tried(provider: EmbeddingProvider, texts: list[str], sleep: Callable[[float], None] = time.sleep, tries: int = TRIES) -> tuple[list | None, str | None, int]:
    """Vectors or an error, and how many calls were made: up to ``tries``, 1 s, then 2 s apart; none for no texts."""
    if not texts:
        return [], None, 0
    for k in range(tries):
        try:
            return provider.embed(texts), None, k + 1
        except Exception as e:  # any failure of the service is tried again
            error = str(e)
            if k < tries - 1:
                sleep(2.0**k)
    return None, error, tries


def _written(spark: SparkSession, ledger: str, provider: EmbeddingProvider) -> DataFrame:
    """All entries of a provider's model and version; those of a slot that is just being closed may come twice."""
    folder = folder_of(ledger, provider)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path) or not any(not x.getPath().getName().startswith(".") for x in files.listStatus(path)):
        return spark.createDataFrame([], ENTRIES)
    return spark.read.schema(ENTRIES).parquet(folder)


def entries(spark: SparkSession, ledger: str, provider: EmbeddingProvider) -> DataFrame:
    """All entries of a provider's model and version, each once."""
    return _written(spark, ledger, provider).dropDuplicates(["call", "content_hash"])


def finished(spark: SparkSession, ledger: str, provider: EmbeddingProvider) -> DataFrame:
    """content_hash and embedding of every text that has one."""
    return _written(spark, ledger, provider).where(F.col("error").isNull()).dropDuplicates(["content_hash"]).select("content_hash", "embedding")


def totals(spark: SparkSession, ledger: str, provider: EmbeddingProvider, run: str) -> dict[str, int]:
    """Calls made in a run, failed ones and repeated tries included, and the tokens that the provider reported."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("calls", *TOKENS)]
    return entries(spark, ledger, provider).where(F.col("run") == run).agg(*sums).first().asDict()


def embed_once(texts: DataFrame, provider: EmbeddingProvider, ledger: str, batch: int = BATCH, run: str | None = None, tries: int = TRIES, among: DataFrame | None = None) -> str:
    """Have every text of ``texts`` (content_hash, text) in the ledger, calling the provider for those that are not; the run's name.

    A batch that fails on every try is entered with its error, and the others go on; a later run tries it again, as does
    none of the same name. Null texts are left out. Texts of one hash are one text.
    ``among`` is a larger table of the same columns that has all of ``texts``, where that is cheaper to read: of ``texts``
    only hashes are shuffled, of ``among`` the texts, once.
    """
    spark, run = texts.sparkSession, run or uuid.uuid4().hex
    folder = folder_of(ledger, provider)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    known = _written(spark, ledger, provider).where(F.col("error").isNull() & (F.col("run") != run)).select("content_hash")
    wanted = texts.where(F.col("text").isNotNull()).select("content_hash").distinct().join(known, "content_hash", "left_anti")
    slots = max(1, -(-wanted.count() // (batch * SLOT_CALLS)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Slot | None = None
        waiting: list[tuple[str, str]] = []
        last: str | None = None

        def call() -> None:
            if waiting:
                hashes, asked = (list(x) for x in zip(*waiting, strict=True))
                waiting.clear()
                vectors, error, made = tried(provider, asked, tries=tries)
                used = {} if error else getattr(provider, "usage", None) or {}
                own.add(hashes, vectors or [None] * len(hashes), error, made, used)

        for rows in batches:
            for slot, known_as, text in zip(*(rows.column(c).to_pylist() for c in range(3)), strict=True):
                if own is None or own.slot != slot:
                    call()
                    if own is not None:
                        own.close()
                    own = _Slot(folder, run, slot)
                if known_as != last and known_as not in own.done:
                    waiting.append((known_as, text))
                    if len(waiting) == batch:
                        call()
                last = known_as
            yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int64())], names=["texts"])
        call()
        if own is not None:
            own.close()

    rows = (texts if among is None else among).where(F.col("text").isNotNull()).select("content_hash", "text")
    slot = F.pmod(F.hash("content_hash"), F.lit(slots)).cast("int")
    if slots >= int(spark.conf.get("spark.sql.shuffle.partitions")):
        # Dealt to slots by the very hash of Spark's shuffles, so that texts meet the hashes wanted where they are embedded.
        dealt = rows.repartition(slots, "content_hash").join(wanted.repartition(slots, "content_hash").hint("merge"), "content_hash", "left_semi").withColumn("slot", slot)
    else:
        dealt = rows.join(wanted, "content_hash", "left_semi").withColumn("slot", slot).repartition(slots, "slot")
    dealt = dealt.select("slot", "content_hash", "text").sortWithinPartitions("slot", "content_hash")
    dealt.mapInArrow(work, "texts long").agg(F.sum("texts")).collect()
    return run
