"""Versioned chunks: idempotent upserts, cut-over between versions, and a snapshot commit.

A table of the store is a folder of snapshots and a pointer that names the current one. A change computes the next
snapshot, writes it to a new folder, and swaps the pointer last: the swap is the commit, and a failure before it leaves
everything as it was. Old chunks are kept, inactive.
"""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions.hashing import chunk_id, content_hash, metadata_hash
from gridlore.operators import ledger as L
from gridlore.operators.intervals import overlap_join
from gridlore.operators.ledger import BATCH, EmbeddingError, EmbeddingProvider
from gridlore.schemas import DOCUMENTS, STORED_CHUNKS
from gridlore.sources.shared import shared_folder

TRIES = L.TRIES


class ChunkStateError(RuntimeError):
    """A version has active and inactive chunks at once, or nothing to activate."""


class HashProvider:
    """Deterministic stand-in without meaning: vectors from a hash of the text. Never a measure of retrieval quality."""

    name, model, version, dimensions = "hash", "hash-64", "1", 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        import numpy as np

        return [np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).normal(size=self.dimensions).tolist() for t in texts]


def with_retry(provider: EmbeddingProvider, texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Up to ``TRIES`` calls, waiting 1 s, then 2 s; no call for no texts."""
    vectors, error, _ = L.tried(provider, texts, sleep, TRIES)
    if error is not None:
        raise EmbeddingError(error)
    return vectors


# ------------------------------------------------------------------ snapshots


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, table: str) -> list[str]:
    """Names of the table's pointers, the newest last."""
    fs, p = _fs(spark, table)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().startswith("CURRENT-")) if fs.exists(p) else []


def current(spark: SparkSession, table: str, schema) -> DataFrame:
    """The table's committed snapshot, which the newest pointer names; empty before the first."""
    pointers = _pointers(spark, table)
    if not pointers:
        return spark.createDataFrame([], schema)
    name = spark.read.text(f"{table}/{pointers[-1]}").first()[0]
    return spark.read.schema(schema).parquet(f"{table}/{name}")


def point(spark: SparkSession, table: str, content: str) -> None:
    """Write the pointer of the next number, by one rename; older ones but the last go."""
    before = _pointers(spark, table)
    number = int(before[-1].partition("-")[2]) + 1 if before else 1
    fs, new = _fs(spark, f"{table}/.pointer-{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(content.encode()))
    out.close()
    target = _fs(spark, f"{table}/CURRENT-{number:012}")[1]
    if fs.exists(target) or not fs.rename(new, target):
        raise OSError(f"{table}: another writer has committed snapshot {number}")
    for old in before[:-1]:
        fs.delete(_fs(spark, f"{table}/{old}")[1], False)


def commit(df: DataFrame, table: str) -> None:
    """Write ``df`` as a new snapshot, then a pointer of the next number, by one rename; older pointers go last.

    Whatever fails on the way, the newest pointer names a whole snapshot. The one before it stays, for readers that
    have just found it. For small tables; ``buckets`` writes what has changed alone. The file system must rename
    atomically, which plain object stores do not.
    """
    name = f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{name}")
    point(df.sparkSession, table, name)


# -------------------------------------------------------------------- upserts


def prepared(chunks: DataFrame, document_hash: Column, document_id: Column, pages: DataFrame | None = None) -> DataFrame:
    """Chunks with their identity and hashes; one of each identity.

    With ``pages``, the map of labels has the PDF page numbers of the chunk's range; else labels stand for themselves.
    """
    label = F.map_from_entries(F.transform("printed_page_number_list", lambda x: F.struct(x.alias("key"), x.alias("value"))))
    out = chunks.withColumns({"embedding_content_hash": content_hash(F.col("text")), "printed_page_number_map": label, "document_id": document_id})
    out = out.withColumns(
        {
            "chunk_metadata_hash": metadata_hash(F.col("printed_page_number_list"), F.col("section_title"), F.col("table_title")),
            "chunk_id": chunk_id(document_hash, F.col("strategy_name"), F.col("chunk_type"), F.col("page_index_start"), F.col("page_index_end"), F.col("embedding_content_hash")),
        }
    )
    out = out.dropDuplicates(["chunk_id"])
    if pages is None:
        return out
    names = out.columns
    return out.drop("printed_page_number_map").join(page_label_map(out, pages), "chunk_id", "left").select(names)


def page_label_map(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_id and its map of PDF page number to printed label: pages within the chunk's range, met by bins."""
    ranges = chunks.select("chunk_id", "source_filename", "page_index_start", "page_index_end")
    pages = pages.select("source_filename", "page_index", "pdf_page_number", "printed_page_number")
    met = overlap_join(pages, ranges, ["source_filename"], ("page_index", "page_index"), ("page_index_start", "page_index_end"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("pdf_page_number").cast("string").alias("key"), F.col("printed_page_number").alias("value"))))
    return met.groupBy("chunk_id").agg(F.map_from_entries(entries).alias("printed_page_number_map"))


def plan_upsert(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` with ``action``: insert, update_metadata or skip. One join on chunk_id."""
    known = stored.select(F.col("chunk_id"), F.col("chunk_metadata_hash").alias("stored_hash"))
    action = F.when(F.col("stored_hash").isNull(), "insert").when(F.col("stored_hash") != F.col("chunk_metadata_hash"), "update_metadata").otherwise("skip")
    return new.join(known, "chunk_id", "left").withColumn("action", action).drop("stored_hash")


_META = ["chunk_metadata_hash", "printed_page_number_map", "section_title", "table_title"]


def _provenance(provider: EmbeddingProvider, at: Column) -> dict[str, Column]:
    return {
        "embedding_provider": F.lit(provider.name), "embedding_model": F.lit(provider.model), "embedding_dimensions": F.lit(provider.dimensions),
        "embedding_model_version": F.lit(provider.version), "embedded_at": at,
    }


def upsert_changes(
    new: DataFrame, stored: DataFrame, provider: EmbeddingProvider, now: datetime.datetime, batch: int = BATCH, ledger: str | None = None
) -> tuple[DataFrame, dict, DataFrame]:
    """The rows that an upsert adds or changes, counters, and the ids that failed.

    Only inserts are embedded, and of those only texts that the ``ledger`` has no vector for; without one, the call gets
    a ledger of its own. New chunks are inactive; a metadata change never touches ``is_active``. ``calls`` counts every
    call that was made, failed ones and repeated tries included; where the provider reports its usage, the counters
    have the tokens of all calls. A chunk fails if its text has no vector in the end.
    """
    spark = new.sparkSession
    ledger = ledger or shared_folder(spark, "ledger")
    plan = plan_upsert(new, stored)
    counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    inserts = plan.where(F.col("action") == "insert")
    texts = lambda rows: rows.select(F.col("embedding_content_hash").alias("content_hash"), "text")
    run = L.embed_once(texts(inserts), provider, ledger, batch, tries=TRIES, among=texts(new))
    vectors = L.finished(spark, ledger, provider).withColumnRenamed("content_hash", "embedding_content_hash")
    failed = inserts.join(vectors, "embedding_content_hash", "left_anti").select("chunk_id")
    n_failed = failed.count()
    at = F.lit(now).cast("timestamp")
    names = STORED_CHUNKS.fieldNames()
    # Vectors go to the chunks, whose texts are shuffled once for it.
    identity = ["chunk_id", "embedding_content_hash"]
    placed = inserts.select(*identity).distinct().join(vectors, "embedding_content_hash")
    made = new.select(*(c for c in new.columns if c != "embedding")).join(placed, identity).withColumns(_provenance(provider, at) | {"is_active": F.lit(False), "created_at": at, "updated_at": at})
    changes = plan.where(F.col("action") == "update_metadata").select("chunk_id", F.struct(*_META).alias("change"))
    changed = stored.join(changes, "chunk_id").withColumns({m: F.col(f"change.{m}") for m in _META} | {"updated_at": at})
    counters = {"inserted": counts.get("insert", 0) - n_failed, "metadata_updated": counts.get("update_metadata", 0), "skipped": counts.get("skip", 0), "failed": n_failed}
    spent = L.totals(spark, ledger, provider, run)
    counters |= spent if hasattr(provider, "usage") else {"calls": spent["calls"]}
    return changed.select(*names).unionByName(made.select(*names)), counters, failed


def apply_upsert(
    new: DataFrame, stored: DataFrame, provider: EmbeddingProvider, now: datetime.datetime, batch: int = BATCH, ledger: str | None = None
) -> tuple[DataFrame, dict, DataFrame]:
    """The next snapshot of the chunks, counters, and the ids that failed; see ``upsert_changes``."""
    changes, counters, failed = upsert_changes(new, stored, provider, now, batch, ledger)
    names = STORED_CHUNKS.fieldNames()
    kept = stored.select(*names).join(changes.select("chunk_id"), "chunk_id", "left_anti").select(*names)
    return kept.unionByName(changes), counters, failed


def get_or_create_document(documents: DataFrame, filename: str, content: str, pages: int, stored: DataFrame, now: datetime.datetime) -> tuple[int, DataFrame]:
    """Id of the document with this content hash, and the documents with it; a new one supersedes the active one of the filename."""
    found = documents.where(F.col("document_content_hash") == content).orderBy("id").head(1)
    if found:
        return found[0]["id"], documents
    active = active_documents(documents, stored).where(F.col("filename") == filename).agg(F.max("id")).first()[0]
    new_id = (documents.agg(F.max("id")).first()[0] or 0) + 1
    row = documents.sparkSession.createDataFrame([(new_id, filename, content, pages, now, active)], DOCUMENTS)
    return new_id, documents.unionByName(row)


def active_documents(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents with an active chunk."""
    return documents.join(stored.where("is_active").select(F.col("document_id").alias("id")), "id", "left_semi")


def superseded_pairs(documents: DataFrame) -> DataFrame:
    """Each document with the one that it replaces."""
    old = documents.select(F.col("id").alias("old_id"), F.col("filename").alias("old_filename"))
    return documents.join(old, F.col("supersedes_document_id") == F.col("old_id")).select("id", "filename", "old_id", "old_filename")


def state_counts(stored: DataFrame, keys: tuple[str, ...] = ("document_id", "strategy_name")) -> DataFrame:
    """Active and inactive chunks of each version, and what follows from them."""
    counts = stored.groupBy(*keys).agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"))
    decision = F.when((F.col("active") > 0) & (F.col("inactive") > 0), "anomaly").when(F.col("active") > 0, "already_active").otherwise("activate")
    return counts.withColumn("decision", decision)


def cutover_changes(stored: DataFrame, documents: DataFrame, document_id: int, strategy: str, failed: DataFrame | None = None) -> tuple[str, DataFrame]:
    """Outcome, and the rows that change: the version's chunks become active, those of the document it supersedes inactive.

    With ``failed`` chunks of its upsert the version stays inactive, and the one before it active. Raises
    ``ChunkStateError`` where the version is partly active. Nothing is written here, so a failure changes nothing.
    """
    none = stored.limit(0)
    if failed is not None and not failed.isEmpty():
        return "failed_chunks", none
    mine = (F.col("document_id") == document_id) & (F.col("strategy_name") == strategy)
    state = state_counts(stored.where(mine)).head(1)
    if not state:
        return "no_chunks", none
    if state[0]["decision"] == "anomaly":
        raise ChunkStateError(f"document {document_id}, {strategy}: {state[0]['active']} active and {state[0]['inactive']} inactive chunks")
    if state[0]["decision"] == "already_active":
        return "already_active", none
    old = documents.where(F.col("id") == document_id).head(1)[0]["supersedes_document_id"]
    replaced = (F.col("document_id") == F.lit(old)) if old is not None else F.lit(False)
    turned = F.when(mine, F.lit(True)).when(replaced, F.lit(False)).otherwise(F.col("is_active"))
    return "activated", stored.withColumn("__turned", turned).where(~F.col("__turned").eqNullSafe(F.col("is_active"))).withColumn("is_active", F.col("__turned")).drop("__turned")


def cutover(stored: DataFrame, documents: DataFrame, document_id: int, strategy: str, failed: DataFrame | None = None) -> tuple[str, DataFrame]:
    """Outcome and next snapshot; see ``cutover_changes``."""
    outcome, changes = cutover_changes(stored, documents, document_id, strategy, failed)
    if outcome != "activated":
        return outcome, stored
    return outcome, stored.join(changes.select("chunk_id"), "chunk_id", "left_anti").select(*stored.columns).unionByName(changes.select(*stored.columns))


def stale(stored: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """Chunks embedded by another model or version, to be embedded again."""
    return stored.where((F.col("embedding_model") != provider.model) | (F.col("embedding_model_version") != provider.version))


def reembedded(stored: DataFrame, provider: EmbeddingProvider, now: datetime.datetime, ledger: str, batch: int = BATCH) -> tuple[DataFrame, dict]:
    """The rows of ``stored`` that another model or version has embedded, embedded again through the ledger, and counters.

    A row whose text fails keeps what it has. Run again after a failure, only what is missing is called for.
    """
    spark, old = stored.sparkSession, stale(stored, provider)
    run = L.embed_once(old.select(F.col("embedding_content_hash").alias("content_hash"), "text"), provider, ledger, batch, tries=TRIES)
    vectors = L.finished(spark, ledger, provider).select(F.col("content_hash").alias("embedding_content_hash"), F.col("embedding").alias("__vector"))
    at = F.lit(now).cast("timestamp")
    done = old.join(vectors, "embedding_content_hash").withColumns({"embedding": F.col("__vector"), "updated_at": at} | _provenance(provider, at))
    return done.select(*stored.columns), L.totals(spark, ledger, provider, run)
