"""The registered queries over the driver's tables, by name."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.functions import text as T
from gridlore.functions.hashing import chunk_id, content_hash, metadata_hash
from gridlore.functions.pages import image_coverage, page_status
from gridlore.operators import answers, battery_plan, buckets, case_search, charts, chunking, retrieval, rules, schedule, timeline, vector_index, versions
from gridlore.operators.intervals import overlap_join
from gridlore.plans import site_day
from gridlore.schemas import STORED_CHUNKS
from gridlore.sources import energy_csv, store
from gridlore.sources.documents import cases_in_series
from gridlore.sources.shared import shared_folder
from gridlore.sources.events_view import read_energy

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Query:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, labels, events, embeddings, conversations = map(_table, ("documents", "labels", "events", "embeddings", "conversations"))


def _catalogue(spark, sf_dir):
    e = read_energy(spark, sf_dir)
    name = F.concat(F.lit("dataset_"), F.col("dataset_id").cast("string"))
    out = e.groupBy("dataset_id").agg(F.count("*").cast("int").alias("row_count"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    return out.select(F.col("dataset_id").alias("id"), name.alias("name"), F.concat(name, F.lit(".csv")).alias("file_name"), F.lit("from events").alias("description"), "row_count", "start_time", "end_time", F.col("end_time").alias("created_at"))


def dataset_list(spark, sf_dir):
    return store.listed(_catalogue(spark, sf_dir))


def dataset_by_id(spark, sf_dir):
    return _catalogue(spark, sf_dir).where(F.col("id") == 2)


def dataset_count(spark, sf_dir):
    return read_energy(spark, sf_dir).where(F.col("dataset_id") == 2).agg(F.count("*").alias("total"))


def dataset_summary(spark, sf_dir):
    rows = store.summary_of(read_energy(spark, sf_dir), 2)
    each = rows.select("dataset_id", F.explode("columns").alias("column", "s"))
    return each.select("dataset_id", "column", F.col("s.min").alias("low"), F.round("s.mean", 6).alias("mean"), F.col("s.max").alias("high"))


def dataset_extent(spark, sf_dir):
    return store.summary_of(read_energy(spark, sf_dir), 2).select("dataset_id", "row_count", "site_count", "start_time", "end_time")


def timeseries_page(spark, sf_dir):
    return store.page_of(read_energy(spark, sf_dir), 1, 50, 20).select("id", "dataset_id", "site_id", "timestamp", "load_kw", "battery_soc", "electricity_price")


def _cells(spark, sf_dir):
    """The events' own values as a file might hold them: numbers, words and JSON in one column."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    pick = lambda *values: F.element_at(F.array(*values), (n % len(values) + 1).cast("int"))
    blank = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return events(spark, sf_dir).select(
        "event_id", pick(F.col("value").cast("string"), blank(k), F.col("event_type"), F.col("props"), F.lit("N/A")).alias("number"),
        pick(F.upper("event_type"), blank(F.col("event_type")), F.lit(""), k).alias("mode"),
        F.when(k.cast("int") < 60, (k.cast("int") % 3).cast("string")).otherwise(pick(F.lit("YES"), F.lit("No"), F.col("event_type"))).alias("boolean"), (F.col("value") - 5.0).alias("soc"),
    )


def quality_range_check(spark, sf_dir):
    return _cells(spark, sf_dir).where((F.col("soc") < 0) | (F.col("soc") > 100)).select("event_id", "soc", F.lit("kept as-is").alias("action"))


def quality_enum_check(spark, sf_dir):
    from gridlore.schemas import EMS_MODES

    cell = energy_csv.present(F.col("mode"))
    return _cells(spark, sf_dir).select("event_id", energy_csv.to_enum(cell, EMS_MODES).alias("mode"), F.coalesce(~T.normalised(cell).isin(EMS_MODES), F.lit(False)).alias("warned"))


def quality_bool_lexicon(spark, sf_dir):
    cell = energy_csv.present(F.col("boolean"))
    value = energy_csv.to_boolean(cell)
    return _cells(spark, sf_dir).select("event_id", value.alias("value"), (cell.isNotNull() & value.isNull()).alias("warned"))


def quality_numeric_coerce(spark, sf_dir):
    cell = energy_csv.present(F.col("number"))
    value = energy_csv.to_number(cell)
    return _cells(spark, sf_dir).select("event_id", value.alias("value"), (cell.isNotNull() & value.isNull()).alias("warned"))


RULE_QUERIES = {
    "rule_pv_deviation": "PV_FORECAST_DEVIATION", "rule_over_contract": "OVER_CONTRACT_RISK", "rule_low_soc": "LOW_SOC_RISK",
    "rule_battery_health": "BATTERY_HEALTH_RISK", "rule_peak_charging": "PEAK_PERIOD_ABNORMAL_CHARGING",
    "rule_should_discharge": "BATTERY_SHOULD_DISCHARGE_BUT_DID_NOT", "rule_green_waste": "GREEN_ENERGY_WASTE",
    "rule_status_warning": "EMS_OR_EQUIPMENT_STATUS_WARNING", "rule_load_increase": "ABNORMAL_LOAD_INCREASE",
}


def _rule(name: str) -> Query:
    def run(spark, sf_dir):
        found = rules.evaluate(read_energy(spark, sf_dir), name)
        return found.where(F.col("flagged") | F.col("severity").isNotNull()).select("id", "dataset_id", "site_id", "timestamp", "flagged", "severity", "explanation")

    return run


def anomalies_all(spark, sf_dir):
    return rules.anomalies(read_energy(spark, sf_dir))


def anomalies_own_bands(spark, sf_dir):
    """All anomalies, where prices are high or low by their dataset's quartiles, from sketches of its days."""
    e = read_energy(spark, sf_dir)
    return rules.anomalies(rules.with_own_bands(e, rules.sketched_bands(rules.price_sketches(e))), rules.OWN_BANDS)


def anomaly_timeline(spark, sf_dir):
    return timeline.periods(read_energy(spark, sf_dir))


def schedule_suggestion(spark, sf_dir):
    return schedule.suggestions(read_energy(spark, sf_dir))


def schedule_windows(spark, sf_dir):
    return schedule.suggestion_windows(read_energy(spark, sf_dir))


def cost_energy(spark, sf_dir):
    return schedule.daily_cost(read_energy(spark, sf_dir))


def cost_arbitrage(spark, sf_dir):
    return schedule.daily_arbitrage(read_energy(spark, sf_dir))


def cost_before_after(spark, sf_dir):
    return schedule.before_after(read_energy(spark, sf_dir))


def green_index_site_day(spark, sf_dir):
    return schedule.green_index(read_energy(spark, sf_dir))


def capacity_fade(spark, sf_dir):
    return schedule.capacity_fade(read_energy(spark, sf_dir))


def site_day_analysis(spark, sf_dir):
    return site_day.site_day_numbers(read_energy(spark, sf_dir))


def price_bands(spark, sf_dir):
    return rules.price_bands(read_energy(spark, sf_dir))


def cycle_trend_7d(spark, sf_dir):
    return timeline.cycle_trend(read_energy(spark, sf_dir))


def load_peak_rank(spark, sf_dir):
    return timeline.load_peaks(read_energy(spark, sf_dir))


def chart_series_bounds(spark, sf_dir):
    return charts.bounds(read_energy(spark, sf_dir))


def stream_hourly_batch(spark, sf_dir):
    from gridlore.streaming.rules_stream import hourly

    out = hourly(read_energy(spark, sf_dir))
    return out.select("site_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "readings", F.round("mean_load_kw", 6).alias("mean_load_kw"), "import_kwh")


# ------------------------------------------------------------------ documents


def pages_view(docs: DataFrame) -> DataFrame:
    """Documents as pages of their source: some with a heading, some with a page number at the end."""
    n = F.col("doc_id")
    text = F.concat(F.when(n % 5 == 0, F.concat(F.lit("4."), (n % 9 + 1).cast("string"), F.lit(" Heading\n"))).otherwise(""), F.coalesce("text", F.lit("")), F.when(n % 3 == 0, F.concat(F.lit("\n "), (n % 9999).cast("string"), F.lit(" \n"))).otherwise(""))
    return docs.select("doc_id", F.col("source").alias("source_filename"), text.alias("text"))


def page_status_query(spark, sf_dir):
    n = F.col("doc_id")
    boxes = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (n % 12).cast("double").alias("x1"), F.lit(10.0).alias("y1")))
    chars = F.length(T.trimmed(F.coalesce("text", F.lit(""))))
    cover = image_coverage(boxes, F.lit(10.0), F.lit(10.0))
    return documents(spark, sf_dir).select("doc_id", chars.alias("char_count"), cover.alias("coverage"), page_status(chars, cover).alias("page_status"))


def page_status_counts(spark, sf_dir):
    return page_status_query(spark, sf_dir).groupBy("page_status").agg(F.count("*").alias("pages"))


def printed_label(spark, sf_dir):
    return pages_view(documents(spark, sf_dir)).select("doc_id", T.printed_page_number(F.col("text")).alias("printed_page_number"))


def section_heading(spark, sf_dir):
    return pages_view(documents(spark, sf_dir)).select("doc_id", T.section_heading(F.col("text")).alias("section_title"))


def section_carry_forward(spark, sf_dir):
    pages = pages_view(documents(spark, sf_dir)).select("source_filename", F.col("doc_id").alias("page_index"), T.section_heading(F.col("text")).alias("section_title"))
    return chunking.with_titles(pages)


def chunk_fixed_600_100(spark, sf_dir):
    whole = documents(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("whole"))
    out = chunking.fixed_windows(whole, ["doc_id"], "whole", 600, 100)
    return out.select("doc_id", "start", F.length("chunk_text").alias("char_count"), content_hash(F.col("chunk_text")).alias("text_hash"))


def _files(docs: DataFrame) -> DataFrame:
    """Documents as pages of one file for each source, with labels and titles."""
    n = F.col("doc_id")
    label, title = F.when(n % 3 != 0, (n % 500).cast("string")), F.when(n % 4 == 0, F.concat(F.lit("4."), (n % 9).cast("string"), F.lit(" Part")))
    return docs.select(F.col("source").alias("source_filename"), n.cast("int").alias("page_index"), label.alias("printed_page_number"), title.alias("section_title"), "text")


def chunk_fixed_pages(spark, sf_dir):
    """Fixed windows over files of many pages."""
    out = chunking.chunk_documents(_files(documents(spark, sf_dir)), "fixed_600_100")
    return out.select(
        "chunk_id", "source_filename", "char_count", "page_index_start", "page_index_end", F.array_join("printed_page_number_list", ",").alias("labels"),
        "section_title", content_hash(F.col("text")).alias("text_hash"),
    )


def chunk_stats_by_strategy(spark, sf_dir):
    """The report over fixed windows of three sizes; ``strategy_comparison`` is over the presets."""
    fixed = [chunking.Strategy(f"fixed_{s}_{o}", "fixed", s, o) for s, o in ((400, 80), (600, 100), (800, 120))]
    return chunking.strategy_report(chunking.unnumbered(_files(documents(spark, sf_dir)), *fixed))


def strategy_comparison(spark, sf_dir):
    """All presets over the same files: the report, and how complete the chunks are."""
    chunks = chunking.unnumbered(_files(documents(spark, sf_dir)), *chunking.STRATEGIES.values())
    return chunking.comparison(chunks, "表", ["10:00", "11:00"], ["the", "of"])


def page_labels(spark, sf_dir):
    """Labels of the pages of ranges that overlap: every page of a file begins one."""
    pages = _files(documents(spark, sf_dir)).withColumn("pdf_page_number", F.col("page_index") + 1)
    first = F.col("page_index")
    ranges = pages.select(first.cast("string").alias("chunk_id"), "source_filename", first.alias("page_index_start"), (first + first % 90).alias("page_index_end"))
    out = versions.page_label_map(ranges, pages)
    entries = F.array_sort(F.transform(F.map_entries("printed_page_number_map"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))))
    return out.select("chunk_id", F.array_join(entries, ",").alias("labels"))


def overlapping_orders(spark, sf_dir):
    """Pairs of a customer's orders that were open at the same time."""
    orders = _table("orders")(spark, sf_dir)
    days = lambda name: orders.select("o_custkey", F.col("o_orderkey").alias(name), F.to_date("o_orderdate").alias(f"{name}_from"), F.date_add("o_orderdate", (F.col("o_orderkey") % 97).cast("int")).alias(f"{name}_to"))
    met = overlap_join(days("a"), days("b"), ["o_custkey"], ("a_from", "a_to"), ("b_from", "b_to")).where("a < b")
    return met.groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.min("a").alias("first_order"), F.max("b").alias("last_order"))


def chunk_structured_600_100(spark, sf_dir):
    docs = documents(spark, sf_dir)
    pages = docs.select(F.format_string("doc_%d", "doc_id").alias("source_filename"), F.lit(0).alias("page_index"), F.lit(None).cast("string").alias("printed_page_number"), F.lit(None).cast("string").alias("section_title"), "text")
    return chunking.chunk_documents(pages, "structured_600_100")


def sentence_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


def content_hash_query(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", content_hash(F.col("text")).alias("content_hash"))


def chunk_id_query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    identity = chunk_id(F.col("source"), F.lit("fixed_600_100"), F.lit("prose"), F.col("doc_id"), F.col("doc_id"), content_hash(F.col("text")))
    return docs.select("doc_id", identity.alias("chunk_id"))


def metadata_hash_query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", metadata_hash(F.array(F.col("doc_id").cast("string")), F.col("lang"), F.lit(None).cast("string")).alias("metadata_hash"))


def _prepared(spark, sf_dir):
    return documents(spark, sf_dir).select(F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_id"), "doc_id", content_hash(F.col("text")).alias("chunk_metadata_hash"))


def upsert_plan(spark, sf_dir):
    new = _prepared(spark, sf_dir)
    changed = F.when(F.col("doc_id") % 2 == 0, F.lit("changed")).otherwise(F.col("chunk_metadata_hash"))
    stored = new.where(F.col("doc_id") % 3 == 0).select("chunk_id", changed.alias("chunk_metadata_hash"))
    return versions.plan_upsert(new, stored).select("doc_id", "action")


def upsert_next_snapshot(spark, sf_dir):
    """A store in buckets: every third chunk is there, half of those with other titles; all are upserted and committed."""
    docs = documents(spark, sf_dir)
    n, now = F.col("document_id"), datetime.datetime(2024, 1, 1)
    page = n.cast("int")
    new = docs.select(
        F.col("doc_id").alias("document_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_id"), F.lit("fixed_600_100").alias("strategy_name"), F.lit("prose").alias("chunk_type"),
        F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("page_index_start"), F.lit(0).alias("page_index_end"), F.lit(1).alias("pdf_page_number_start"), F.lit(1).alias("pdf_page_number_end"),
        F.create_map(F.lit("1"), F.lit("1")).alias("printed_page_number_map"), F.col("lang").alias("section_title"), F.lit(None).cast("string").alias("table_title"),
        content_hash(F.coalesce("text", F.lit(""))).alias("embedding_content_hash"), F.coalesce("lang", F.lit("")).alias("chunk_metadata_hash"),
    )
    was = new.where(n % 3 == 0).withColumns({
        "section_title": F.when(page % 2 == 0, F.lit("old")).otherwise(F.col("section_title")), "chunk_metadata_hash": F.when(page % 2 == 0, F.lit("old")).otherwise(F.col("chunk_metadata_hash")),
        "embedding": F.array(F.lit(0.0).cast("float")), "embedding_provider": F.lit("p"), "embedding_model": F.lit("before"), "embedding_dimensions": F.lit(1), "embedding_model_version": F.lit("0"),
        "embedded_at": F.lit(now).cast("timestamp"), "is_active": n % 4 != 0, "created_at": F.lit(now).cast("timestamp"), "updated_at": F.lit(now).cast("timestamp"),
    })
    store = shared_folder(spark, "chunks")
    buckets.commit_changes(was.select(*STORED_CHUNKS.fieldNames()), store)
    later = now + datetime.timedelta(days=1)
    changes, _, _ = versions.upsert_changes(new, buckets.current(spark, store, STORED_CHUNKS), versions.HashProvider(), later)
    buckets.commit_changes(changes, store)
    out = buckets.current(spark, store, STORED_CHUNKS)
    return out.select("document_id", "section_title", "is_active", "embedding_model", F.size("embedding").alias("dimensions"), (F.col("updated_at") > F.col("created_at")).alias("updated"), (F.col("created_at") > F.lit(now).cast("timestamp")).alias("new"))


def duplicate_content(spark, sf_dir):
    hashed = documents(spark, sf_dir).select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id")).where(F.col("copies") > 1)


def _stored(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang")
    state = docs.join(labels(spark, sf_dir), "doc_id")
    return state.select("doc_id", F.col("source").alias("document_id"), F.col("lang").alias("strategy_name"), (F.col("quality") == 1).alias("is_active"))


def lifecycle_counts(spark, sf_dir):
    return versions.state_counts(_stored(spark, sf_dir)).drop("decision")


def lifecycle_decision(spark, sf_dir):
    return versions.state_counts(_stored(spark, sf_dir)).select("document_id", "strategy_name", "decision")


def active_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("filename"))
    stored = labels(spark, sf_dir).select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("is_active"))
    return versions.active_documents(docs, stored)


def superseded_pairs(spark, sf_dir):
    """Every document supersedes the one of the same text and source before it."""
    before = F.lag("doc_id").over(Window.partitionBy("source", F.sha2("text", 256)).orderBy("doc_id"))
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), before.alias("supersedes_document_id"))
    return versions.superseded_pairs(docs)


# ------------------------------------------------------------------ retrieval


def _chunks(spark, sf_dir):
    n = F.col("vec_id")
    return embeddings(spark, sf_dir).select(
        F.format_string("%08d", n).alias("chunk_id"), n.alias("vec_id"), "embedding", "label", F.concat(F.lit("doc_"), (n % 4).cast("string")).alias("filename"),
        F.when(n % 3 == 0, "table").otherwise("prose").alias("chunk_type"), (n % 10 != 9).alias("is_active"),
        F.concat(F.lit("chunk 2024 年5 月"), (n % 28 + 1).cast("string"), F.lit(" 日")).alias("text"),
    )


def _asked(spark, sf_dir):
    n = F.col("vec_id")
    question = F.concat(F.lit("2024年5月"), (n % 28 + 1).cast("string"), F.lit("日 "), F.when(n % 100 == 0, "表 3").otherwise("表格"))
    return embeddings(spark, sf_dir).where(n % 50 == 0).select(n.alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"), question.alias("question"))


def vector_topk(spark, sf_dir):
    pool = retrieval.candidates(_chunks(spark, sf_dir), _asked(spark, sf_dir), 5)
    return pool.select("query_id", "vector_rank", "chunk_id", F.round("distance", 6).alias("distance"))


def vector_topk_scoped(spark, sf_dir):
    pool = retrieval.candidates(_chunks(spark, sf_dir), _asked(spark, sf_dir), 5, "doc_1")
    return pool.select("query_id", "vector_rank", "chunk_id", F.round("distance", 6).alias("distance"))


def indexed_topk(spark, sf_dir):
    """The nearest chunks by inverted lists, which are met until no other can hold a nearer one."""
    chunks = _chunks(spark, sf_dir)
    centres = vector_index.fit(chunks, "chunk_id")
    listed = vector_index.in_lists(chunks, centres)
    pool = vector_index.search(listed, _asked(spark, sf_dir), vector_index.with_radii(listed, centres), 5, exact=True)
    return pool.select("query_id", "vector_rank", "chunk_id", F.round("distance", 6).alias("distance"))


def search_in_both_scopes(spark, sf_dir):
    asked = _asked(spark, sf_dir).withColumn("source_document", F.concat(F.lit("doc_"), (F.col("query_id") % 4).cast("string")))
    pool = retrieval.in_both_scopes(_chunks(spark, sf_dir), asked, 5)
    return pool.select("scope", "query_id", "vector_rank", "chunk_id", F.round("distance", 6).alias("distance"))


def page_overlap_hit(spark, sf_dir):
    start = (F.col("vec_id") % 30).cast("int")
    chunks = _chunks(spark, sf_dir).withColumns({"pdf_page_number_start": start, "pdf_page_number_end": start + 2})
    asked = _asked(spark, sf_dir)
    questions = asked.select("query_id", F.when(F.col("query_id") % 100 == 0, F.col("query_id") % 30).cast("int").alias("pdf_page_number"))
    return retrieval.page_hits(retrieval.candidates(chunks, asked, 5), questions)


def chunks_with_filenames(spark, sf_dir):
    stored = embeddings(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 700).alias("document_id"))
    named = retrieval.with_filenames(stored, documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("filename")))
    return named.select("chunk_id", "document_id", "filename")


def _ranked(spark, sf_dir):
    """The pool of each question, re-scored; a question's own row is no answer to it."""
    pool = retrieval.candidates(_chunks(spark, sf_dir), _asked(spark, sf_dir), retrieval.POOL + 1)
    return retrieval.rescored(retrieval.without_own(pool, F.col("vec_id") == F.col("query_id")), F.col("question"))


def hybrid_topk(spark, sf_dir):
    top = retrieval.hybrid_search(_chunks(spark, sf_dir), _asked(spark, sf_dir))
    return top.select("query_id", "hybrid_rank", "vector_rank", "chunk_id", "date_match", "table_match", F.round("final_score", 6).alias("final_score"))


def order_unchanged(spark, sf_dir):
    return retrieval.order_unchanged(_ranked(spark, sf_dir))


def wrong_group_rate(spark, sf_dir):
    graded = _ranked(spark, sf_dir).withColumn("document_correct", F.col("label") == F.col("query_label"))
    return retrieval.wrong_document_rate(graded, "vector_rank").select("wrong", "candidates", F.round("rate", 6).alias("rate"))


def hit_at_k(spark, sf_dir):
    graded = _ranked(spark, sf_dir).withColumn("correct", F.col("label") == F.col("query_label"))
    return retrieval.hit_ranks(graded, "vector_rank")


def benchmark_grades(spark, sf_dir):
    """Questions graded by document, page and content, over all documents and within their own, by both ranks."""
    n = F.col("query_id")
    start = (F.col("vec_id") % 30).cast("int")
    chunks = _chunks(spark, sf_dir).withColumns({"pdf_page_number_start": start, "pdf_page_number_end": start + 9})
    asked = _asked(spark, sf_dir).withColumn("source_document", F.concat(F.lit("doc_"), (n % 4).cast("string")))
    place = F.struct((n % 30).cast("int").alias("pdf_page_number"))
    keywords = F.array(F.lit("2024"), F.concat(F.lit("月"), (n % 3 + 1).cast("string")))
    questions = asked.select(n.alias("id"), "source_document", place.alias("expected_location"), keywords.alias("expected_content_keywords"), (n % 7 != 0).alias("retrieval_eval_eligible"))
    pools = retrieval.in_both_scopes(chunks, asked, retrieval.POOL + 1).drop("source_document")
    own = F.col("vec_id") == n
    ranked = retrieval.rescored(retrieval.without_own(pools, own, by=("scope", "query_id")), F.col("question"), by=("scope", "query_id"))
    graded = retrieval.graded(ranked, questions)
    hits = [retrieval.hit_ranks(graded, rank, ("scope", "query_id")).withColumn("ranked_by", F.lit(rank)) for rank in ("vector_rank", "hybrid_rank")]
    return hits[0].unionByName(hits[1])


def keyword_coverage(spark, sf_dir):
    turns = conversations(spark, sf_dir).select(F.col("conv_id").alias("query_id"), "text", (F.col("turn") + 1).alias("rank"))
    keywords = turns.select("query_id").distinct().select("query_id", F.array(F.lit("the"), F.lit("tion"), F.lit("que")).alias("keywords"), F.lit(0.6).alias("threshold"))
    out = retrieval.keyword_coverage(turns, keywords, "rank", 3)
    return out.select("query_id", F.round("coverage", 6).alias("coverage"), "success")


def keyword_coverage_many(spark, sf_dir):
    """The distinct words of each conversation's first turn, in the turns after it: many keywords, each text read once."""
    turns = conversations(spark, sf_dir)
    first = turns.where(F.col("turn") == 0).groupBy(F.col("conv_id").alias("query_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(F.coalesce("text", F.lit("")), " "))))).alias("keywords"))
    ranked = turns.where(F.col("turn") > 0).select(F.col("conv_id").alias("query_id"), "text", F.col("turn").alias("rank"))
    out = retrieval.keyword_coverage(ranked, first.withColumn("threshold", F.lit(0.2)), "rank", 3)
    return out.select("query_id", F.round("coverage", 6).alias("coverage"), "success")


def _questions(spark, sf_dir):
    """Questions about an order's date, and, for the larger ones, about a second date and a table."""
    written = lambda d, gap: F.concat(F.year(d).cast("string"), F.lit(f"{gap}年{gap}"), F.month(d).cast("string"), F.lit(f"{gap}月{gap}"), F.dayofmonth(d).cast("string"), F.lit(f"{gap}日"))
    placed, price = F.to_date("o_orderdate"), F.col("o_totalprice")
    later = F.date_add(placed, (F.col("o_custkey") % 400).cast("int"))
    more = F.when(price > 100000, F.concat(F.lit("與"), written(later, ""), F.lit(" 表 "), F.substring("o_orderpriority", 1, 1))).otherwise("表格")
    return _table("orders")(spark, sf_dir).select("o_orderkey", F.concat(F.lit("見 "), written(placed, " "), F.col("o_orderstatus"), more).alias("question"))


def date_candidates(spark, sf_dir):
    found = _questions(spark, sf_dir).select("o_orderkey", F.posexplode(T.dates(F.col("question"))).alias("place", "d"))
    return found.select("o_orderkey", "place", "d.year", "d.month", "d.day")


def table_question(spark, sf_dir):
    return _questions(spark, sf_dir).select("o_orderkey", T.is_table_question(F.col("question")).alias("is_table_question"))


def range_overlap(spark, sf_dir):
    orders, lines = _table("orders")(spark, sf_dir), _table("lineitem")(spark, sf_dir)
    met = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    from_, to = F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    shipped, due = F.col("l_shipdate"), F.col("l_shipdate") + F.expr("INTERVAL 10 DAYS")
    return met.where(retrieval.ranges_overlap(shipped, due, from_, to)).groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.countDistinct("o_orderkey").alias("orders"))


def case_time_range(spark, sf_dir):
    """Readings of each case's dataset in its range of time, counted."""
    e = read_energy(spark, sf_dir)
    day = F.to_date("timestamp").cast("timestamp_ntz").alias("day")
    after = lambda hours: F.col("day") + F.expr(f"INTERVAL {hours} HOURS")
    cases = e.select("dataset_id", day).distinct().select(
        F.concat_ws("-", F.col("dataset_id").cast("string"), F.date_format("day", "yyyy-MM-dd")).alias("case_id"), F.col("dataset_id").alias("related_dataset_id"),
        F.struct(after(6).alias("start"), after(60).alias("end")).alias("related_time_range"),
    )
    return cases_in_series(cases, e).groupBy("case_id").agg(F.count("*").alias("readings"), F.max("load_kw").alias("peak_load_kw"))


def case_evidence(spark, sf_dir):
    """Anomalies met with the cases of their kind: readings and cases of each rule and severity."""
    kinds = list(rules.RULES)
    names = F.element_at(F.array(*map(F.lit, kinds)), (F.col("vec_id") % len(kinds) + 1).cast("int"))
    cases = embeddings(spark, sf_dir).select(names.alias("rule")).groupBy("rule").agg(F.count("*").alias("cases"))
    found = rules.anomalies(read_energy(spark, sf_dir)).groupBy("rule", "severity").agg(F.count("*").alias("readings"))
    return found.join(F.broadcast(cases), "rule")  # one row for each rule


def evidence_answers(spark, sf_dir):
    """Seven-part answers of all findings, with the cases and passages of their kind; parts that are lists are given as text."""
    kinds, n = list(rules.RULES), F.col("vec_id")
    named = F.element_at(F.array(*map(F.lit, kinds)), (n % len(kinds) + 1).cast("int"))
    text = lambda p, k: F.concat(F.lit(p), (n % k).cast("string"))
    cases = embeddings(spark, sf_dir).select(n.alias("case_id"), named.alias("event_type"), text("cause_", 7).alias("root_cause"), text("action_", 3).alias("operator_action"))
    # Every second rule has one passage for each rank up to its place among the rules.
    pages = F.col("page_index")
    hits = _files(documents(spark, sf_dir)).select(
        F.element_at(F.array(*map(F.lit, kinds)), (2 * (pages % 4) + 1).cast("int")).alias("rule"), (F.floor(pages / 4) + 1).cast("int").alias("rank"),
        pages.cast("string").alias("chunk_id"), F.col("source_filename").alias("filename"), pages.alias("page_index_start"), (pages + 1).alias("page_index_end"),
    ).where(F.col("rank") <= F.col("page_index_start") % 4 + 1)
    out = answers.answers(answers.findings(rules.anomalies(read_energy(spark, sf_dir))), cases, hits)
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit(":"), x["cases"].cast("string"))), ",")
    cited = F.array_join(F.transform("citations", lambda x: F.concat(x["source"], F.lit(":"), x["reference"])), ",")
    return out.select(
        "dataset_id", "site_id", "day", "rule", F.col("finding.readings").alias("readings"), F.col("evidence.cases").alias("cases"), F.col("evidence.passages").alias("passages"),
        listed("possible_causes").alias("causes"), listed("next_checks").alias("actions"), "confidence", cited.alias("citations"),
    )


def case_similarity(spark, sf_dir):
    """The cases most like every tenth one, by their symptoms (whole texts), causes, actions, tags and types."""
    n = F.col("doc_id")
    numbered = lambda name, k: F.concat(F.lit(f"{name} "), (n % k).cast("string"))
    cases = documents(spark, sf_dir).select(
        n.alias("case_id"), F.col("source").alias("event_type"), F.col("text").alias("symptoms"), numbered("cause", 30).alias("root_cause"), numbered("action", 25).alias("operator_action"),
        F.array(F.concat(F.lit("lang "), F.col("lang")), numbered("part", 40)).alias("tags"),
    )
    out = case_search.similar_to(cases, cases.where(F.col("case_id") % 10 == 0))
    return out.select("query_id", "case_id", "rank", F.round("score", 6).alias("score"), F.array_join("matching", ",").alias("matching"), F.array_join("differing", ",").alias("differing"))


def battery_plans(spark, sf_dir):
    """The cheapest day that each site's battery could follow."""
    out = battery_plan.battery_plans(read_energy(spark, sf_dir))
    return out.select("site_id", "day", *(F.round(c, 4).alias(c) for c in ("cost_before", "cost_planned", "saving", "charge_first", "charge_last")), F.size("plan").alias("hours"))


def queries() -> dict[str, Query]:
    plain = [
        dataset_list, dataset_by_id, dataset_count, dataset_summary, dataset_extent, timeseries_page, quality_range_check, quality_enum_check,
        quality_bool_lexicon, quality_numeric_coerce, anomalies_all, anomalies_own_bands, anomaly_timeline, schedule_suggestion, schedule_windows, cost_energy, cost_arbitrage,
        cost_before_after, battery_plans, green_index_site_day, capacity_fade, site_day_analysis, price_bands, cycle_trend_7d, load_peak_rank, chart_series_bounds,
        stream_hourly_batch, page_status_counts, printed_label, section_heading, section_carry_forward, chunk_fixed_600_100, chunk_fixed_pages, chunk_stats_by_strategy, strategy_comparison, page_labels, overlapping_orders,
        chunk_structured_600_100, sentence_split, upsert_plan, upsert_next_snapshot, duplicate_content, lifecycle_counts, lifecycle_decision, active_documents, superseded_pairs,
        vector_topk, indexed_topk, vector_topk_scoped, search_in_both_scopes, page_overlap_hit, chunks_with_filenames, hybrid_topk, order_unchanged, wrong_group_rate, hit_at_k, benchmark_grades, keyword_coverage, keyword_coverage_many, date_candidates, table_question,
        range_overlap, case_time_range, case_evidence, evidence_answers, case_similarity,
    ]
    named = {f.__name__: f for f in plain}
    named |= {"page_status": page_status_query, "content_hash": content_hash_query, "chunk_id": chunk_id_query, "metadata_hash": metadata_hash_query}
    return named | {q: _rule(r) for q, r in RULE_QUERIES.items()}
