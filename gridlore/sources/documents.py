"""Document sources and sinks: pages, questions, cases, plain texts, reports, and the recognition plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.functions.pages import is_scanned, page_status, status_after_ocr
from gridlore.functions.text import printed_page_number, section_heading, trimmed
from gridlore.operators.intervals import overlap_join
from gridlore.schemas import CASES, PAGES

#: bytes of a file -> (text, image coverage) of each page
PageParser = Callable[[bytes], list[tuple[str, float]]]
#: (file name, page index) -> recognised lines
Recogniser = Callable[[str, int], list[str]]


def classify(raw: DataFrame) -> DataFrame:
    """Pages (source_filename, page_index, text, image_coverage_ratio) with labels, headings and statuses, see ``PAGES``."""
    text = F.coalesce("text", F.lit(""))
    chars = F.length(trimmed(text))
    status = page_status(chars, F.col("image_coverage_ratio"))
    return raw.select(
        "source_filename", "page_index", (F.col("page_index") + 1).alias("pdf_page_number"), printed_page_number(text).alias("printed_page_number"),
        section_heading(text).alias("section_title"), status.alias("page_status"), F.when(status == "text", "text_layer").otherwise("none").alias("extraction_method"),
        text.alias("text"), chars.alias("char_count"), F.col("image_coverage_ratio"),
    )


def parse_files(spark: SparkSession, paths: str, parser: PageParser) -> DataFrame:
    """Pages of binary files (a PDF library is the caller's), with ``document_content_hash``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples():
                pages = parser(f.content)
                yield pd.DataFrame({"source_filename": f.name, "page_index": range(len(pages)), "text": [p[0] for p in pages], "image_coverage_ratio": [float(p[1]) for p in pages]})

    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return classify(files.mapInPandas(run, "source_filename string, page_index int, text string, image_coverage_ratio double"))


def file_hashes(spark: SparkSession, paths: str) -> DataFrame:
    """Each file's name and the SHA-256 of its bytes."""
    return spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("document_content_hash"))


#: Readers of this worker, by the key of what builds them.
_READERS: dict[str, Recogniser] = {}


def reader_of(key: str, build: Callable[[], Recogniser]) -> Recogniser:
    """The worker's reader of this key, built at its first use."""
    if key not in _READERS:
        _READERS[key] = build()
    return _READERS[key]


def recognise(pages: DataFrame, recogniser: Recogniser | None = None, build: Callable[[], Recogniser] | None = None, key: str = "default") -> DataFrame:
    """Pages whose scanned ones have gone through a recogniser.

    Either the recogniser itself, or ``build``, which makes one and may take long: each worker calls it at its first
    scanned page and keeps the result, for later tasks and jobs of the same ``key``, too.
    """
    if (recogniser is None) == (build is None):
        raise ValueError("a recogniser, or what builds one")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from gridlore.sources.documents import reader_of  # the worker's own, not a copy sent with this function

        for pdf in batches:
            if not len(pdf):
                continue
            read, pdf = recogniser or reader_of(key, build), pdf.copy()
            pdf["text"] = ["\n".join(read(p.source_filename, int(p.page_index))) for p in pdf.itertuples()]
            yield pdf

    scanned = pages.where(F.col("page_status") == "scanned").mapInPandas(run, PAGES)
    chars = F.length(trimmed(F.col("text")))
    status = status_after_ocr(F.col("page_status"), chars)
    done = scanned.withColumns({"char_count": chars, "page_status": status, "extraction_method": F.when(status == "text", "ocr").otherwise("none")})
    return pages.where(F.col("page_status") != "scanned").unionByName(done)


def parsing_report(pages: DataFrame) -> DataFrame:
    """Pages as rows of a report: rounded ratio, 200 characters of text."""
    return pages.select("source_filename", "pdf_page_number", "page_status", is_scanned(F.col("page_status")).alias("scanned"), F.round("image_coverage_ratio", 3).alias("image_coverage_ratio"), F.substring("text", 1, 200).alias("preview"))


def status_counts(pages: DataFrame) -> DataFrame:
    """Each file's pages by status."""
    counts = pages.groupBy("source_filename", "page_status").agg(F.count("*").alias("n"))
    return counts.groupBy("source_filename").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_status", "n")))).alias("pages_by_status"))


def read_questions(spark: SparkSession, path: str, ids: list[str] | None = None, tier: str | None = None) -> DataFrame:
    """Questions of a JSON file's ``questions`` list, by id or by verification tier."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")
    if ids is not None:
        rows = rows.where(F.col("id").isin(ids))
    return rows.where(F.col("verification_tier") == tier) if tier is not None else rows


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case records from CSV or JSON; tags and the time range are taken apart."""
    reader = spark.read.schema(CASES)
    rows = reader.option("multiLine", True).json(path) if path.endswith(".json") else reader.option("header", True).option("multiLine", True).csv(path)
    ends = F.split("related_time_range", r"\s*~\s*")
    at = lambda k: F.try_to_timestamp(F.try_element_at(ends, F.lit(k))).cast("timestamp_ntz")
    tags = F.filter(F.transform(F.split("tags", ","), trimmed), lambda t: F.length(t) > 0)
    return rows.withColumns({"tags": tags, "related_time_range": F.struct(at(1).alias("start"), at(2).alias("end"))})


def cases_in_series(cases: DataFrame, series: DataFrame) -> DataFrame:
    """Readings of each case's dataset in its time range, with ``case_id``; met by dataset and bins of time."""
    ranges = cases.select("case_id", F.col("related_dataset_id").alias("dataset_id"), F.col("related_time_range.start").alias("__start"), F.col("related_time_range.end").alias("__end"))
    return overlap_join(series, ranges, ["dataset_id"], ("timestamp", "timestamp"), ("__start", "__end")).drop("__start", "__end")


def read_texts(spark: SparkSession, paths: str) -> DataFrame:
    """TXT or MD files as one page each."""
    rows = spark.read.option("wholetext", True).text(paths).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_filename"), F.col("value").alias("text"))
    return classify(rows.withColumns({"page_index": F.lit(0), "image_coverage_ratio": F.lit(0.0)}))


def document_chunks(chunks: DataFrame, filename: str) -> DataFrame:
    return chunks.where(F.col("source_filename") == filename).withColumn("n", F.row_number().over(Window.partitionBy("source_filename").orderBy("chunk_id"))).orderBy("n").drop("n")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_run(spark: SparkSession, path: str, kind: str, result: DataFrame, now) -> None:
    """An analysis run: its kind, time, and each row of its result as JSON."""
    result.select(F.lit(kind).alias("run_type"), F.lit(now).cast("timestamp").alias("created_at"), F.to_json(F.struct("*")).alias("result_json")).write.mode("append").parquet(path)
