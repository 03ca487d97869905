import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from gridlore.functions import text as T
from gridlore.functions.hashing import chunk_id, content_hash, metadata_hash
from gridlore.functions.pages import image_coverage, page_status, status_after_ocr
from gridlore.operators import chunking, retrieval, versions
from gridlore.schemas import DOCUMENTS, PAGES, STORED_CHUNKS
from gridlore.sources import documents as D

NOW = datetime.datetime(2024, 1, 1)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_text_functions(spark):
    f = lambda c, x: one(spark, c(F.col("x")), x=x)
    assert f(T.trimmed, "　 a b ") == "a b"
    assert f(T.lines, "a\r\nb\x0bc d\n") == ["a", "b", "c", "d"] and f(T.lines, "") == []
    assert f(T.printed_page_number, "title\ntext\n 12 ") == "12" and f(T.printed_page_number, "xiv\nXIV\n\nend") is None
    assert f(T.printed_page_number, "IX\nmiddle\nend") == "IX" and f(T.printed_page_number, "") is None
    assert f(T.section_heading, "x\n 一、總論\n") == "一、總論" and f(T.section_heading, "3.381\n4.2 Costs") == "4.2 Costs"
    assert [tuple(d) for d in f(T.dates, "2024年5月4日與2024 年 12 月 31 日")] == [(2024, 5, 4), (2024, 12, 31)]
    assert f(T.dates, "2024/05/04") == [] and f(T.dates, "none") == []
    assert f(T.is_table_question, "表4 有什麼") and not f(T.is_table_question, "這個表格")
    assert f(T.sentences, "一。二！three. four") == ["一。", "二！", "three.", " four"]
    assert f(lambda c: T.slices(c, 2), "abcde") == ["ab", "cd", "e"]
    keys = lambda *k: F.array(*map(F.lit, k)).cast("array<string>")
    long = "z" * 200 + "key"
    assert f(lambda c: T.contains_all(c, keys("key", "z")), long) and not f(lambda c: T.contains_all(c, keys("key", "no")), long)
    assert not f(lambda c: T.contains_all(c, keys()), long)
    assert f(lambda c: T.mentions_date(c, T.dates(F.lit("2024年8月4日"))), "於 2024 年8 月 4日") and not f(lambda c: T.mentions_date(c, T.dates(F.lit("2024年8月4日"))), "2024年08月4日")


def test_page_functions(spark):
    rows = [(25, 0.9), (5, 0.5), (5, 0.1)]
    t = spark.createDataFrame(rows, "n int, c double")
    assert [r[0] for r in t.select(page_status(F.col("n"), F.col("c"))).collect()] == ["text", "scanned", "near_empty"]
    t = spark.createDataFrame([("scanned", 30), ("scanned", 3), ("text", 30)], "s string, n int")
    assert [r[0] for r in t.select(status_after_ocr(F.col("s"), F.col("n"))).collect()] == ["text", "ocr_failed", "text"]
    box = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(5.0).alias("y1")))
    assert one(spark, image_coverage(box, F.lit(10.0), F.lit(30.0)), x=1) == 0.5 and one(spark, image_coverage(box, F.lit(1.0), F.lit(1.0)), x=1) == 1.0
    assert one(spark, image_coverage(box, F.lit(0.0), F.lit(1.0)), x=1) == 0.0


def test_hashes(spark):
    import hashlib

    assert one(spark, content_hash(F.col("x")), x="漢字") == hashlib.sha256("漢字".encode()).hexdigest()
    ids = {one(spark, chunk_id(F.lit("d"), F.lit("s"), F.lit("prose"), F.lit(a), F.lit(1), F.lit("h")), x=1) for a in (0, 1, 0)}
    assert len(ids) == 2
    labels = F.array(F.lit("1"))
    meta = [one(spark, metadata_hash(labels, F.lit(s).cast("string"), F.lit(None).cast("string")), x=1) for s in ("a", None, "a")]
    assert meta[0] == meta[2] != meta[1]


def pages(spark, texts, titles=None, source="doc"):
    rows = [(source, k, k + 1, str(9 + k), titles[k] if titles else None, "text", "text_layer", t, len(t.strip()), 0.0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, PAGES)


HEADER = ["日期", "時間", "需量 (kW)", "市電 (kW)", "PV (kW)", "儲能 (kW)", "SOC (%)"]


def dated(day, n):
    return [f"2024 年5 月{day} 日"] + [x for k in range(n) for x in (f"10:{k:02d}~10:{k + 15:02d}", f"{100 + k}", "1", "2", "3", "4")]


def chunks(spark, texts, size, overlap=20, **kw):
    got = chunking.chunk_structured(pages(spark, texts, **kw), chunking.Strategy("t", "structured", size, overlap))
    assert got.where(chunking.invalid_reason().isNotNull()).count() == 0
    return [r.asDict() for r in got.orderBy("chunk_id").collect()]


def of(found, kind):
    return [c for c in found if c["chunk_type"] == kind]


def in_order(found):
    return sorted(found, key=lambda c: int(c["chunk_id"].rsplit("::", 1)[1]))


DATED = "\n".join(["以下為事件：", *HEADER, *dated(4, 3), *dated(5, 6), "表4. 系統超約事件紀錄", "之後的說明文字。"])


def test_date_anchored_table(spark):
    found = chunks(spark, [DATED], 220)
    tables = in_order(of(found, "table"))
    assert all(c["text"].startswith("表4. 系統超約事件紀錄\n" + " ".join(HEADER) + "\n") for c in tables)
    assert [c for c in tables if "2024 年5 月5 日" in c["text"] and "10:05~10:20" in c["text"]]
    assert "以下為事件" in of(found, "prose")[0]["text"] and "說明文字" in of(found, "prose")[-1]["text"]
    small = in_order(of(chunks(spark, [DATED], 80), "table"))
    assert len(small) > len(tables)
    body = [x for c in small for x in c["text"].split("\n")[2:]]
    assert body == dated(4, 3) + dated(5, 6)  # no line is lost or torn from its row


def test_oversized_group_and_unknown_title(spark):
    found = of(chunks(spark, ["\n".join([*HEADER, *dated(4, 20)])], 60), "table")
    assert len(found) > 1 and found[0]["table_title"] == chunking.UNKNOWN_TITLE


CAPTIONED = ["前言。", "表 3-1 電池系統組成", "項目", "電壓", "3.381", "容量", "圖 3-1 示意圖", "結尾。"]


def test_caption_first_tables(spark):
    t = of(chunks(spark, ["\n".join(CAPTIONED)], 400), "table")
    assert len(t) == 1 and t[0]["table_title"] == "表 3-1 電池系統組成" and "圖 3-1" not in t[0]["text"] and "3.381" in t[0]["text"]
    assert len(of(chunks(spark, ["\n".join(CAPTIONED[:2] + [""] + CAPTIONED[2:])], 400), "table")) == 1
    contents = "表 3-1 電池 ......... 15\n表 3-2 容量 ......... 16\n表 3-3 其他 ....... 17"
    assert not of(chunks(spark, [contents], 400), "table")
    both = of(chunks(spark, [DATED + "\n" + "\n".join(CAPTIONED)], 900), "table")
    assert len(both) == 2 and "電池系統" not in both[0]["text"] + both[1]["text"].replace("表 3-1 電池系統組成", "") or len(both) == 2
    first = of(chunks(spark, ["\n".join(CAPTIONED[:6]), "第二頁的內容。"], 400), "table")[0]
    assert (first["page_index_start"], first["page_index_end"]) == (0, 0) and "第二頁" not in first["text"]


def test_rows_that_tell_a_table_may_be_on_the_next_page(spark):
    """Up to ten rows tell a table, over a page's end too; what follows them is taken from the caption's page alone."""
    t = of(chunks(spark, ["表 3-1 電池\n一\n二", "三\n四\n五\n結尾。"], 400), "table")
    assert [c["text"].split("\n")[2:] for c in t] == [["一", "二", "三", "四", "五"]]
    assert (t[0]["page_index_start"], t[0]["page_index_end"]) == (0, 1)
    rows = [f"row {k}" for k in range(30)]
    t = of(chunks(spark, ["表 3-1 電池\n" + "\n".join(rows[:4]), "\n".join(rows[4:])], 900), "table")
    assert t[0]["text"].split("\n")[2:] == rows[:10]
    t = of(chunks(spark, ["表 3-1 電池\n" + "\n\n".join(rows[:4] + rows[4:]), "more"], 900), "table")
    assert not t  # a blank line between rows ends the run that tells a table
    t = of(chunks(spark, ["表 3-1 電池\n" + "\n".join(rows[:5]) + "\n\n" + "\n".join(rows[5:]), "more"], 900), "table")
    assert t[0]["text"].split("\n")[2:] == rows
    many = [f"r{k}" for k in range(80)]
    t = of(chunks(spark, ["表 3-1 電池\n" + "\n".join(many)], 9000), "table")
    assert t[0]["text"].split("\n")[2:] == many[:60]


def test_prose_packing_overlaps(spark):
    text = "\n\n".join(f"Sentence number {k} is here." * 2 for k in range(30))
    found = in_order(chunks(spark, [text], 200, 40))
    assert len(found) > 3 and max(c["char_count"] for c in found) <= 241
    assert all(b["text"].startswith(a["text"][-40:]) for a, b in zip(found, found[1:]))


def test_fixed_windows(spark):
    texts = ["abcdefghij" * 13, "x" * 55]
    got = [r.asDict() for r in chunking.chunk_fixed(pages(spark, texts, titles=["T", None]), chunking.Strategy("f", "fixed", 100, 20)).orderBy("chunk_id").collect()]
    whole = "".join(t + "\n" for t in texts)
    assert [c["text"] for c in got] == [whole[s : s + 100] for s in range(0, len(whole) - 20, 80)]
    assert [(c["page_index_start"], c["page_index_end"]) for c in got] == [(0, 0), (0, 1), (1, 1)][: len(got)]
    report = chunking.strategy_report(chunking.chunk_fixed(pages(spark, texts), chunking.Strategy("f", "fixed", 100, 20))).first()
    assert report["failures"] == 0 and report["chunks"] == len(got)


@pytest.mark.parametrize("size, overlap", [(5, 2), (10, 0), (7, 6), (600, 100)])
def test_window_starts_follow_the_loop(spark, size, overlap):
    got = {r["n"]: r["s"] for r in spark.range(0, 60).select(F.col("id").cast("int").alias("n")).select("n", chunking.window_starts(F.col("n"), size, overlap).alias("s")).collect()}
    for n, starts in got.items():
        want, at = [], 0
        while at < n:
            want.append(at)
            if at + size >= n:
                break
            at += size - overlap
        assert starts == want


def test_titles_carried_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PAGES_TOGETHER", 3)
    rows = [(f, k, "T%d" % k if k % 8 == 1 and f != "b" else None) for f in ("a", "b", None) for k in range(30)]
    table = spark.createDataFrame(rows, "source_filename string, page_index int, section_title string")
    got = {(r["source_filename"], r["page_index"]): r["carried_title"] for r in chunking.with_titles(table).collect()}
    want = {(f, k): None if k < 1 or f == "b" else "T%d" % ((k - 1) // 8 * 8 + 1) for f, k, _ in rows}
    assert got == want


def test_carried_titles_and_completeness(spark):
    got = chunking.with_titles(pages(spark, ["a", "b", "c"], titles=[None, "T", None])).orderBy("page_index").collect()
    assert [r["carried_title"] for r in got] == [None, "T", "T"]
    found = chunking.chunk_structured(pages(spark, [DATED + "\nA和B"]), chunking.STRATEGIES["structured_800_120"])
    row = chunking.completeness(found, "2024 年5 月4 日", ["10:00~10:15", "10:01~10:16"], ["A", "B"]).first()
    assert row["rate"] == "2/2" and row["table_reason"] is None


# -------------------------------------------------------------------- versions


class Stub:
    name, model, version, dimensions = "stub", "m", "1", 3

    def __init__(self, fails=()):
        self.fails = fails

    def embed(self, texts):
        if any(f in t for t in texts for f in self.fails):
            raise RuntimeError("down")
        return [[1.0, 2.0, 3.0] for _ in texts]


def test_caption_at_the_end_of_a_page(spark):
    """Its rows are those on the next page; neither they nor the caption are lost."""
    found = of(chunks(spark, ["前言。\n表 3-1 電池系統組成", "項目\n電壓\n3.381\n容量"], 400), "table")
    assert len(found) == 1 and found[0]["text"].split() == ["表", "3-1", "電池系統組成", "項目", "電壓", "3.381", "容量"]
    assert found[0]["text"].replace("\n\n", "\n").split("\n") == ["表 3-1 電池系統組成", "項目", "電壓", "3.381", "容量"]


def test_rows_of_captioned_tables(spark):
    """Few blank lines may stand before the first of three rows, none between them; some ends of lines are no rows'."""
    caption = "表 3-1 電池系統組成"
    assert not of(chunks(spark, ["\n".join([caption, "項目", "電壓", "", "容量"])], 400), "table")
    assert not of(chunks(spark, ["\n".join([caption, "項目", "說明：", "電壓", "容量"])], 400), "table")
    assert of(chunks(spark, ["\n".join([caption, "", "", "項目", "電壓", "容量", "", "其他"])], 400), "table")[0]["text"].endswith("其他")
    inside = of(chunks(spark, ["\n".join([caption, "項目", "電壓", "容量", "表 3-2 容量 ..... 16", "其他"])], 400), "table")
    assert len(inside) == 1 and "其他" in inside[0]["text"]


def test_metadata_hash_is_that_of_json_text(spark):
    import hashlib

    for labels, section, table in ((["1", None, "ii"], '第 3 章 "x"\n\\', None), ([], None, "表 3-1"), (["9"], "a", "b")):
        text = json.dumps({"printed_page_number_list": labels, "section_title": section, "table_title": table}, sort_keys=True, ensure_ascii=False)
        row = spark.createDataFrame([(labels, section, table)], "l array<string>, s string, t string")
        assert row.select(metadata_hash(F.col("l"), F.col("s"), F.col("t"))).first()[0] == hashlib.sha256(text.encode()).hexdigest()


def new_chunks(spark, texts, doc=1, title="T"):
    rows = [("x", f"d{doc}", "prose", t, len(t), 0, 0, 1, 1, ["1"], title, "s", None) for t in texts]
    from gridlore.schemas import CHUNKS

    return versions.prepared(spark.createDataFrame(rows, CHUNKS), F.lit(f"hash{doc}"), F.lit(doc).cast("long"))


def upsert(spark, tmp_path, new, provider=Stub(), batch=96):
    stored = versions.current(spark, f"{tmp_path}/chunks", STORED_CHUNKS)
    out, counts, failed = versions.apply_upsert(new, stored, provider, NOW, batch)
    versions.commit(out, f"{tmp_path}/chunks")
    return counts, failed.count()


def stored(spark, tmp_path):
    return versions.current(spark, f"{tmp_path}/chunks", STORED_CHUNKS)


class Counting(Stub):
    """Reports its usage; a text "none" leaves it out."""

    usage = None

    def embed(self, texts):
        self.usage = None if "none" in texts else {"prompt_tokens": sum(map(len, texts)), "total_tokens": None if "part" in texts else 100}
        return super().embed(texts)


def test_tokens_of_calls_are_summed(spark, tmp_path):
    texts = ["abc", "none", "part", "de"]
    counts, failed = upsert(spark, tmp_path, new_chunks(spark, texts), Counting(), 1)
    assert failed == 0 and counts["prompt_tokens"] == 9 and counts["total_tokens"] == 200
    again, _ = upsert(spark, tmp_path, new_chunks(spark, texts), Counting(), 1)
    assert again["skipped"] == 4 and again["prompt_tokens"] == again["total_tokens"] == 0


def test_version_life(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "TRIES", 1)
    docs = spark.createDataFrame([(1, "f", "hash1", 1, NOW, None), (2, "f", "hash2", 1, NOW, 1)], DOCUMENTS)
    first = new_chunks(spark, ["a", "b", "b"])
    assert upsert(spark, tmp_path, first)[0] == {"inserted": 2, "metadata_updated": 0, "skipped": 0, "failed": 0, "calls": 1}
    assert stored(spark, tmp_path).where("is_active").count() == 0
    outcome, out = versions.cutover(stored(spark, tmp_path), docs, 1, "s")
    assert outcome == "activated"
    versions.commit(out, f"{tmp_path}/chunks")
    assert upsert(spark, tmp_path, first)[0] == {"inserted": 0, "metadata_updated": 0, "skipped": 2, "failed": 0, "calls": 0}
    assert versions.cutover(stored(spark, tmp_path), docs, 1, "s")[0] == "already_active"
    assert upsert(spark, tmp_path, new_chunks(spark, ["a", "b"], title="U"))[0]["metadata_updated"] == 2
    assert stored(spark, tmp_path).where("is_active AND section_title = 'U'").count() == 2
    # A second version whose second batch fails stays inactive; the retry completes it.
    second = new_chunks(spark, ["c", "bad"], doc=2)
    counts, failed = upsert(spark, tmp_path, second.orderBy("text"), Stub(("bad",)), 1)
    assert failed == 1 and counts["inserted"] == 1 and stored(spark, tmp_path).where("is_active").count() == 2
    assert upsert(spark, tmp_path, second)[0]["inserted"] == 1
    outcome, out = versions.cutover(stored(spark, tmp_path), docs, 2, "s")
    versions.commit(out, f"{tmp_path}/chunks")
    state = {r["document_id"]: (r["active"], r["inactive"]) for r in versions.state_counts(stored(spark, tmp_path)).collect()}
    assert outcome == "activated" and state == {1: (0, 2), 2: (2, 0)}
    assert [r["id"] for r in versions.active_documents(docs, stored(spark, tmp_path)).collect()] == [2]
    assert [tuple(r) for r in versions.superseded_pairs(docs).select("id", "old_id").collect()] == [(2, 1)]
    assert versions.cutover(stored(spark, tmp_path), docs, 7, "s")[0] == "no_chunks"
    mixed = stored(spark, tmp_path).withColumn("is_active", F.col("text") == "a")
    with pytest.raises(versions.ChunkStateError):
        versions.cutover(mixed, docs, 1, "s")
    assert versions.stale(stored(spark, tmp_path), versions.HashProvider()).count() == 4


def test_a_failed_pointer_leaves_the_current_snapshot(spark, tmp_path, monkeypatch):
    upsert(spark, tmp_path, new_chunks(spark, ["a"]))
    before, whole = versions._fs, stored(spark, tmp_path)

    def broken(session, path):
        if "CURRENT-" in path:
            raise OSError("stop")
        return before(session, path)

    monkeypatch.setattr(versions, "_fs", broken)
    with pytest.raises(OSError):
        versions.commit(whole.limit(0), f"{tmp_path}/chunks")
    monkeypatch.setattr(versions, "_fs", before)
    assert stored(spark, tmp_path).count() == 1
    for n in (0, 1, 0):  # and later ones follow each other
        versions.commit(whole.limit(n), f"{tmp_path}/chunks")
        assert stored(spark, tmp_path).count() == n


def test_failed_chunks_keep_a_version_from_going_live(spark, tmp_path):
    docs = spark.createDataFrame([(1, "f", "hash1", 1, NOW, None)], DOCUMENTS)
    upsert(spark, tmp_path, new_chunks(spark, ["a", "b"]))
    table = stored(spark, tmp_path)
    outcome, out = versions.cutover(table, docs, 1, "s", table.limit(1).select("chunk_id"))
    assert outcome == "failed_chunks" and out.where("is_active").count() == 0
    assert versions.cutover(table, docs, 1, "s", table.limit(0).select("chunk_id"))[0] == "activated"


def test_labels_by_pdf_page(spark):
    from gridlore.schemas import CHUNKS

    rows = [("x", "doc", "prose", "t", 1, 0, 1, 1, 2, ["9", "10"], None, "s", None)]
    got = versions.prepared(spark.createDataFrame(rows, CHUNKS), F.lit("h"), F.lit(1).cast("long"), pages(spark, ["a", "b", "c"])).first()
    assert got["printed_page_number_map"] == {"1": "9", "2": "10"}


def test_a_failed_write_leaves_the_current_snapshot(spark, tmp_path):
    upsert(spark, tmp_path, new_chunks(spark, ["a"]))
    broken = stored(spark, tmp_path).withColumn("text", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        versions.commit(broken, f"{tmp_path}/chunks")
    assert stored(spark, tmp_path).count() == 1


def test_documents_are_found_by_content(spark, tmp_path):
    docs = spark.createDataFrame([(4, "f", "hash4", 1, NOW, None)], DOCUMENTS)
    upsert(spark, tmp_path, new_chunks(spark, ["a"], doc=4))
    versions.commit(versions.cutover(stored(spark, tmp_path), docs, 4, "s")[1], f"{tmp_path}/chunks")
    assert versions.get_or_create_document(docs, "f", "hash4", 1, stored(spark, tmp_path), NOW)[0] == 4
    new_id, out = versions.get_or_create_document(docs, "f", "other", 1, stored(spark, tmp_path), NOW)
    assert new_id == 5 and out.where("id = 5").first()["supersedes_document_id"] == 4


def test_provider_is_tried_again():
    calls, waits = [], []

    class Flaky(Stub):
        def embed(self, texts):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError("busy")
            return super().embed(texts)

    assert versions.with_retry(Flaky(), ["a"], waits.append) == [[1.0, 2.0, 3.0]] and waits == [1.0, 2.0]
    assert versions.with_retry(Flaky(), [], waits.append) == [] and len(calls) == 3
    with pytest.raises(versions.EmbeddingError):
        versions.with_retry(Stub(("a",)), ["a"], waits.append)


# ------------------------------------------------------------------- retrieval


def pool(spark, rows):
    return spark.createDataFrame([(1, f"c{k}", kind, text, d, k + 1) for k, (kind, text, d) in enumerate(rows)], "query_id int, chunk_id string, chunk_type string, text string, distance double, vector_rank int")


def order(spark, question, rows):
    got = retrieval.rescored(pool(spark, rows), F.lit(question)).orderBy("hybrid_rank").collect()
    return [r["chunk_id"] for r in got], [round(r["final_score"], 6) for r in got]


def test_signals_reorder_the_pool(spark):
    assert order(spark, "什麼", [("prose", "a", 0.40), ("table", "b", 0.45), ("prose", "c", 0.50)]) == (["c0", "c1", "c2"], [0.6, 0.55, 0.5])
    assert order(spark, "2024年5月4日", [("prose", "2024年5月5日", 0.40), ("prose", "2024 年5 月4 日", 0.45)])[0] == ["c1", "c0"]
    assert order(spark, "表4", [("prose", "a", 0.40), ("table", "b", 0.42)])[0] == ["c1", "c0"]
    assert order(spark, "表4 2024年5月4日", [("table", "2024年5月4日", 0.40)])[1] == [1.3]


def test_search_leaves_out_null_zero_and_inactive(spark):
    chunks = [("a", [1.0, 0.0], True, "f"), ("b", [1.0, 0.1], True, "g"), ("c", None, True, "f"), ("d", [0.0, 0.0], True, "f"), ("e", [1.0, 0.0], False, "f")]
    table = spark.createDataFrame([(i, v, a, f, "prose", "t") for i, v, a, f in chunks], "chunk_id string, embedding array<float>, is_active boolean, filename string, chunk_type string, text string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "q")], "query_id int, query_vector array<float>, question string")
    assert [r["chunk_id"] for r in retrieval.hybrid_search(table, asked).orderBy("hybrid_rank").collect()] == ["a", "b"]
    assert [r["chunk_id"] for r in retrieval.hybrid_search(table, asked, document="g").collect()] == ["b"]


def test_search_of_more_queries_than_a_block(spark, monkeypatch):
    """Blocks on both sides, ties, vectors of two lengths and repeated ones, against every distance."""
    monkeypatch.setattr(retrieval, "MOST_QUESTIONS", 7)
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", 90)
    vector = lambda i: [float(i * i % 7 - 3), float(i % 5), 1.0] + [2.0] * (i % 9 == 0)
    chunks = [(f"c{i % 90:02}x{i}", vector(i)) for i in range(120)]
    asked = [(i, vector(3 * i)) for i in range(40)]
    table = spark.createDataFrame(chunks, "chunk_id string, embedding array<float>")
    got = {}
    for r in retrieval.candidates(table, spark.createDataFrame(asked, "query_id int, query_vector array<float>"), 6).collect():
        got.setdefault(r["query_id"], []).append((r["vector_rank"], r["chunk_id"], r["distance"]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    norm = lambda a: math.sqrt(dot(a, a))
    for i, q in asked:
        met = sorted((1.0 - dot(v, q) / (norm(v) * norm(q)), c) for c, v in chunks if len(v) == len(q))
        assert sorted(got[i]) == [(k + 1, c, d) for k, (d, c) in enumerate(met[:6])]


def test_grading(spark):
    page = spark.createDataFrame([(63, 64, p) for p in (63, 64, 65, None)], "a int, b int, p int")
    assert [r[0] for r in page.select(retrieval.page_in_range(F.col("a"), F.col("b"), F.col("p"))).collect()] == [True, True, False, False]
    ranked = spark.createDataFrame([(1, "f", 1, 1, "x key", 1), (1, "f", 2, 3, "key word", 2), (2, "g", 1, 1, "none", 1)], "query_id int, filename string, pdf_page_number_start int, pdf_page_number_end int, text string, vector_rank int")
    asked = [(1, "f", True, (2, None, None), ["key"]), (2, "g", True, (None, None, None), []), (3, "h", False, (1, None, None), ["a"])]
    q = spark.createDataFrame(asked, "id int, source_document string, retrieval_eval_eligible boolean, expected_location struct<pdf_page_number:int,printed_page_number:string,section_title:string>, expected_content_keywords array<string>").withColumn("eligibility_reason", F.lit("why"))
    hits = {r["query_id"]: (r["hit_rank"], r["hit_at_1"], r["hit_at_3"]) for r in retrieval.hit_ranks(retrieval.graded(ranked, q), "vector_rank").collect()}
    assert hits == {1: (2, False, True), 2: (None, False, False)}
    assert [r["id"] for r in retrieval.skipped(q).collect()] == [3]
    words = spark.createDataFrame([(1, ["key", "zebra"], None), (2, ["none"], 0.5)], "query_id int, keywords array<string>, threshold double")
    cover = {r["query_id"]: (r["coverage"], r["success"]) for r in retrieval.keyword_coverage(ranked, words, "vector_rank", 5).collect()}
    assert cover == {1: (0.5, False), 2: (1.0, True)}


# --------------------------------------------------------------------- sources


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "1", "verification_tier": "a"}, {"id": "2", "verification_tier": "b"}]}))
    assert [r["id"] for r in D.read_questions(spark, f"{tmp_path}/q.json", tier="b").collect()] == ["2"]
    assert [r["id"] for r in D.read_questions(spark, f"{tmp_path}/q.json", ids=["1"]).collect()] == ["1"]
    (tmp_path / "c.csv").write_text("case_id,site_id,event_time,event_type,symptoms,root_cause,operator_action,resolution_result,severity,tags,related_dataset_id,related_time_range\n1,s,2024-01-01 00:00:00,T,a,b,c,d,low,\"x, y\",1,2024-01-01 00:00:00 ~ 2024-01-01 02:00:00\n")
    case = D.read_cases(spark, f"{tmp_path}/c.csv")
    row = case.first()
    assert row["tags"] == ["x", "y"] and row["related_time_range"]["end"].hour == 2
    series = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, h)) for h in range(5)], "dataset_id long, timestamp timestamp_ntz")
    assert D.cases_in_series(case, series).count() == 3
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.bin").write_text("page one is long enough to count\fscan")
    parse = lambda content: [(t, 0.8) for t in content.decode().split("\f")]
    found = D.parse_files(spark, f"{tmp_path}/docs", parse)
    assert {r["page_index"]: r["page_status"] for r in found.collect()} == {0: "text", 1: "scanned"}
    done = {r["page_index"]: (r["page_status"], r["extraction_method"]) for r in D.recognise(found, lambda f, k: ["recognised text of the page"]).collect()}
    assert done == {0: ("text", "text_layer"), 1: ("text", "ocr")}
    failed = D.recognise(found, lambda f, k: ["x"])
    assert D.status_counts(failed).first()["pages_by_status"] == {"ocr_failed": 1, "text": 1}
    D.write_report(D.parsing_report(failed), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2
    assert D.read_texts(spark, f"{tmp_path}/docs").count() == 1 and D.file_hashes(spark, f"{tmp_path}/docs").count() == 1
    D.append_run(spark, f"{tmp_path}/runs", "test", found.select("page_index"), NOW)
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2


def test_questions_are_embedded(spark):
    asked = spark.createDataFrame([(k, None if k == 3 else f"q{k}") for k in range(7)], "query_id long, question string")
    provider = versions.HashProvider()
    got = {r["query_id"]: r["query_vector"] for r in retrieval.embedded_questions(asked, provider).collect()}
    assert got == {k: None if k == 3 else provider.embed([f"q{k}"])[0] for k in range(7)}


def test_scopes_and_page_hits(spark):
    rows = [("a", "f", [1.0, 0.0], 1, 2), ("b", "g", [1.0, 0.1], 5, 6), ("c", "g", [0.0, 1.0], 8, 8)]
    chunks = spark.createDataFrame(rows, "chunk_id string, filename string, embedding array<double>, pdf_page_number_start int, pdf_page_number_end int")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "g", 6), (2, [0.0, 1.0], None, None)], "query_id long, query_vector array<double>, source_document string, pdf_page_number int")
    both = retrieval.in_both_scopes(chunks, asked, 1)
    assert sorted((r["scope"], r["query_id"], r["chunk_id"]) for r in both.collect()) == [("all_documents", 1, "a"), ("all_documents", 2, "c"), ("document_scoped", 1, "b")]
    hits = lambda df: {r["query_id"]: r["hit"] for r in retrieval.page_hits(df, asked).collect()}
    ranked = both.drop("pdf_page_number")
    assert hits(ranked.where("scope = 'document_scoped'")) == {1: True, 2: False}
    assert hits(ranked.where("scope = 'all_documents'")) == {1: False, 2: False}
    stored = spark.createDataFrame([("a", 1, None), ("b", 9, None)], "chunk_id string, document_id long, filename string")
    docs = spark.createDataFrame([(1, "f.pdf")], "id long, filename string")
    assert [(r["chunk_id"], r["filename"]) for r in retrieval.with_filenames(stored, docs).collect()] == [("a", "f.pdf")]
