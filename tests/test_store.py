"""Bucketed tables, and the ledger of embedding calls."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from gridlore.operators import buckets, ledger, versions
from gridlore.schemas import STORED_CHUNKS

NOW = datetime.datetime(2024, 1, 1)
ROWS = "chunk_id string, v int"


class Logging:
    """Writes each call's texts to a file; dies, or fails for a while, as it is told."""

    name, model, version, dimensions = "log", "m", "1", 1

    def __init__(self, path, die_after=None, fail_first=0, bad=(), usage=None):
        self.path, self.die_after, self.fail_first, self.bad = str(path), die_after, fail_first, bad
        if usage is not None:
            self.usage = usage

    def calls(self):
        if not os.path.exists(self.path):
            return []
        with open(self.path) as f:
            return [line.rstrip("\n").split("|") for line in f]

    def embed(self, texts):
        made = self.calls()
        if self.die_after is not None and len(made) == self.die_after:
            os._exit(3)
        with open(self.path, "a") as f:
            f.write("|".join(texts) + "\n")
        if len(made) < self.fail_first or set(texts) & set(self.bad):
            raise OSError("busy")
        return [[float(len(t))] for t in texts]


def texts(spark, n, low=0):
    return spark.range(low, n).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))


# ----------------------------------------------------------------- buckets


def written(table):
    return {os.path.join(d, f) for d, _, files in os.walk(table) for f in files if f.endswith(".parquet")}


def test_one_changed_row_writes_one_bucket(spark, tmp_path):
    table = f"{tmp_path}/t"
    rows = spark.range(10_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.col("id").cast("int").alias("v"))
    assert buckets.commit_changes(rows, table, buckets=16) == list(range(16))
    before = written(table)
    touched = buckets.commit_changes(spark.createDataFrame([("c77", -1)], ROWS), table)
    new = written(table) - before
    assert len(touched) == 1 and len(new) == 1
    assert spark.read.parquet(*new).count() < 1000
    got = buckets.current(spark, table, rows.schema)
    assert got.count() == 10_000 and got.where("v = -1").first()["chunk_id"] == "c77"
    assert buckets.current(spark, table, rows.schema, touched).count() == spark.read.parquet(*new).count()
    assert buckets.commit_changes(rows.limit(0), table) == [] and written(table) == before | new


def test_changes_may_be_computed_from_the_table_itself(spark, tmp_path):
    table = f"{tmp_path}/t"
    buckets.commit_changes(spark.createDataFrame([(f"c{k}", k) for k in range(50)], ROWS), table, buckets=4)
    for _ in range(3):
        now = buckets.current(spark, table, ROWS)
        buckets.commit_changes(now.where("v % 2 = 0").withColumn("v", F.col("v") + 100), table)
    assert {r["chunk_id"]: r["v"] for r in buckets.current(spark, table, ROWS).collect()} == {f"c{k}": k if k % 2 else k + 300 for k in range(50)}
    n = buckets.swept(spark, table)
    assert n == 2 and buckets.current(spark, table, ROWS).count() == 50 and buckets.swept(spark, table) == 0


def test_a_crash_before_the_pointer_changes_nothing(spark, tmp_path, monkeypatch):
    table = f"{tmp_path}/t"
    buckets.commit_changes(spark.createDataFrame([("a", 1), ("b", 2)], ROWS), table, buckets=4)

    def crash(*_):
        raise OSError("stop")

    with monkeypatch.context() as m:
        m.setattr(versions, "point", crash)
        with pytest.raises(OSError):
            buckets.commit_changes(spark.createDataFrame([("a", 9), ("c", 3)], ROWS), table)
    read = lambda: {tuple(r) for r in buckets.current(spark, table, ROWS).collect()}
    assert read() == {("a", 1), ("b", 2)}
    buckets.commit_changes(spark.createDataFrame([("a", 9), ("c", 3)], ROWS), table)
    assert read() == {("a", 9), ("b", 2), ("c", 3)}
    assert buckets.current(spark, f"{tmp_path}/none", ROWS).count() == 0


def test_a_second_writer_fails_at_the_rename(spark, tmp_path, monkeypatch):
    """Another writer's commit, made after this one has looked, stays."""
    table = f"{tmp_path}/t"
    buckets.commit_changes(spark.createDataFrame([("a", 1)], ROWS), table, buckets=2)
    before = versions._pointers(spark, table)
    buckets.commit_changes(spark.createDataFrame([("a", 2)], ROWS), table)
    with monkeypatch.context() as m:
        m.setattr(versions, "_pointers", lambda *_: before)
        with pytest.raises(OSError, match="another writer"):
            versions.point(spark, table, "{}")
    assert buckets.current(spark, table, ROWS).first()["v"] == 2


# ------------------------------------------------------------------ ledger


@pytest.mark.parametrize("same_run", [True, False])
def test_a_killed_task_pays_for_no_finished_call_again(spark, tmp_path, same_run):
    """The worker dies in its third call; the next run, or the same one tried again, makes only the calls that are missing."""
    log, where = tmp_path / "calls", f"{tmp_path}/ledger"
    asked = texts(spark, 50)
    with pytest.raises(Exception):
        ledger.embed_once(asked, Logging(log, die_after=2), where, batch=8, run="r")
    assert len(Logging(log).calls()) == 2
    run = ledger.embed_once(asked, Logging(log), where, batch=8, run="r" if same_run else "s")
    made = Logging(log).calls()
    assert sorted(t for call in made for t in call) == sorted(f"t{k}" for k in range(50)) and len(made) == 7
    assert ledger.totals(spark, where, Logging(log), run)["calls"] == (7 if same_run else 5)
    got = {r["content_hash"]: r["embedding"] for r in ledger.finished(spark, where, Logging(log)).collect()}
    assert got == {r["content_hash"]: [float(len(r["text"]))] for r in asked.collect()}
    ledger.embed_once(texts(spark, 60, 40), Logging(log), where)
    assert len(Logging(log).calls()) == 8 and sorted(Logging(log).calls()[-1]) == sorted(f"t{k}" for k in range(50, 60))


def test_calls_are_counted_where_they_are_made(spark, tmp_path, monkeypatch):
    """Repeated tries and failed batches are calls; tokens are those that were reported; a failure is tried by the next run."""
    monkeypatch.setattr(ledger.time, "sleep", lambda s: None)
    log, where = tmp_path / "calls", f"{tmp_path}/ledger"
    provider = Logging(log, fail_first=1, bad=("t3",), usage={"prompt_tokens": 5, "total_tokens": None})
    asked = texts(spark, 6).unionByName(texts(spark, 3)).unionByName(spark.createDataFrame([("x", None)], "content_hash string, text string"))
    run = ledger.embed_once(asked, provider, where, batch=1, tries=2)
    assert ledger.totals(spark, where, provider, run) == {"calls": 8 if len(Logging(log).calls()) == 8 else 7, "prompt_tokens": 25, "total_tokens": 0}
    assert ledger.totals(spark, where, provider, run)["calls"] == len(Logging(log).calls())
    assert ledger.entries(spark, where, provider).where("error = 'busy'").count() == 1
    again = ledger.embed_once(asked, Logging(log), where)
    assert ledger.totals(spark, where, provider, again)["calls"] == 1 and ledger.finished(spark, where, provider).count() == 6
    other = Logging(log)
    other.version = "2"
    assert ledger.finished(spark, where, other).count() == 0


def stored_chunks(spark, n):
    rows = spark.range(n).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.lit(1).cast("long").alias("document_id"), F.lit("s").alias("strategy_name"), F.lit("prose").alias("chunk_type"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), *(F.lit(k).alias(c) for c, k in (("page_index_start", 0), ("page_index_end", 0), ("pdf_page_number_start", 1), ("pdf_page_number_end", 1))),
        F.create_map(F.lit("1"), F.lit("1")).alias("printed_page_number_map"), F.lit("T").alias("section_title"), F.lit(None).cast("string").alias("table_title"),
        F.sha2(F.concat(F.lit("t"), F.col("id").cast("string")), 256).alias("embedding_content_hash"), F.lit("m").alias("chunk_metadata_hash"),
    )
    at = F.lit(NOW).cast("timestamp")
    return rows.withColumns({
        "embedding": F.array(F.lit(0.0).cast("float")), "embedding_provider": F.lit("log"), "embedding_model": F.when(F.col("chunk_id") == "c0", "m").otherwise("old"), "embedding_dimensions": F.lit(1),
        "embedding_model_version": F.lit("1"), "embedded_at": at, "is_active": F.lit(True), "created_at": at, "updated_at": at,
    }).select(*STORED_CHUNKS.fieldNames())


def test_another_model_embeds_again_through_the_ledger(spark, tmp_path):
    log, where, table = tmp_path / "calls", f"{tmp_path}/ledger", f"{tmp_path}/chunks"
    buckets.commit_changes(stored_chunks(spark, 20), table, buckets=4)
    later = NOW + datetime.timedelta(days=1)
    changes, counts = versions.reembedded(buckets.current(spark, table, STORED_CHUNKS), Logging(log, bad=("t7",)), later, where, batch=1)
    buckets.commit_changes(changes, table)
    now = buckets.current(spark, table, STORED_CHUNKS)
    assert [r["chunk_id"] for r in versions.stale(now, Logging(log)).collect()] == ["c7"] and counts["calls"] == 18 + versions.TRIES
    assert now.where("is_active AND embedding_model = 'm' AND embedding[0] = length(text)").count() == 18
    changes, counts = versions.reembedded(now, Logging(log), later, where)
    assert counts["calls"] == 1 and [r["chunk_id"] for r in changes.collect()] == ["c7"]


def test_an_upsert_of_known_texts_makes_no_call(spark, tmp_path):
    """A text that another chunk had embedded is paid for; only changed rows are given to the commit."""
    log, where, table = tmp_path / "calls", f"{tmp_path}/ledger", f"{tmp_path}/chunks"
    whole = stored_chunks(spark, 10)
    upsert = lambda new: versions.upsert_changes(new, buckets.current(spark, table, STORED_CHUNKS), Logging(log), NOW, ledger=where)
    changes, counts, failed = upsert(whole)
    buckets.commit_changes(changes, table, buckets=4)
    assert counts == {"inserted": 10, "metadata_updated": 0, "skipped": 0, "failed": 0, "calls": 1} and failed.count() == 0
    moved = whole.withColumn("chunk_id", F.concat("chunk_id", F.lit("x"))).limit(4).unionByName(whole.where("chunk_id = 'c1'").withColumns({"chunk_metadata_hash": F.lit("n"), "section_title": F.lit("U")}))
    changes, counts, _ = upsert(moved)
    assert counts == {"inserted": 4, "metadata_updated": 1, "skipped": 0, "failed": 0, "calls": 0} and changes.count() == 5
    buckets.commit_changes(changes, table)
    now = buckets.current(spark, table, STORED_CHUNKS)
    assert now.count() == 14 and now.where("section_title = 'U'").count() == 1 and not now.where("is_active").count()
    docs = spark.createDataFrame([(1, None)], "id long, supersedes_document_id long")
    outcome, changes = versions.cutover_changes(now, docs, 1, "s")
    assert outcome == "activated" and changes.count() == 14
    buckets.commit_changes(changes, table)
    assert buckets.current(spark, table, STORED_CHUNKS).where("is_active").count() == 14


def test_an_upsert_shuffles_texts_once_to_embed_them(spark, tmp_path, monkeypatch):
    """Texts meet the hashes wanted in their slots, and are not dealt again; each is embedded once, copies and chunks that are there aside."""
    log, plans = tmp_path / "calls", []
    new = stored_chunks(spark, 50).drop("embedding")
    copies = new.withColumn("chunk_id", F.concat(F.lit("copy"), F.col("chunk_id")))
    kind = type(new)
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or run(df, *a, **k))
    monkeypatch.setattr(ledger, "SLOT_CALLS", 1)
    changes, counters, failed = versions.upsert_changes(new.unionByName(copies), stored_chunks(spark, 10), Logging(log), NOW, batch=3, ledger=f"{tmp_path}/ledger")
    assert "hashpartitioning(slot" not in plans[0] and plans[0].count("REPARTITION_BY_NUM") == 2
    assert sorted(t for call in Logging(log).calls() for t in call) == sorted(f"t{k}" for k in range(50))
    assert counters["inserted"] == 90 and counters["skipped"] == 10 and failed.count() == 0
    rows = changes.collect()
    assert len(rows) == 90 and all(r["embedding"] == [float(len(r["text"]))] for r in rows)
