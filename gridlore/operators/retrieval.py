"""Vector search re-scored by date and table signals, and its grading."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gridlore.functions.text import contains_all, dates, is_table_question, mentions_date, preview
from gridlore.functions.vectors import cosine_distance, norm
from gridlore.operators.keywords import vocabulary, with_found

#: Candidates by distance that are re-scored; a better match beyond them is not seen.
POOL = 30
#: Questions of a block; more are asked in blocks of about so many. Up to so many are broadcast where they are graded.
MOST_QUESTIONS = 10_000
#: Numbers of the vectors of a block of chunks or questions.
BLOCK_NUMBERS = 1 << 22
#: Distances that are worked on at once, or those of one question.
DISTANCES = 1 << 19


@dataclass(frozen=True)
class Weights:
    similarity: float = 1.0
    date: float = 0.5
    table: float = 0.2


def _vectors(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The vectors of the rows, which have one length."""
    chosen = column if len(rows) == len(column) else column.take(pa.array(rows))
    flat = chosen.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _nearest(x: np.ndarray, x_norm: np.ndarray, place: np.ndarray, asked: np.ndarray, asked_norm: np.ndarray, k: int):
    """For each asked vector the rows of x that are its k nearest, and their distances; ties to the least place.

    Matrix products pick the rows that may be among them; those are summed up in the order of ``cosine_distance``.
    """
    for low in range(0, len(asked), step := max(1, DISTANCES // len(x))):
        away = (asked[low : low + step] / asked_norm[low : low + step, None]) @ x.T
        away /= x_norm
        np.subtract(1.0, away, out=away)
        limit = np.partition(away, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(away), np.inf)
        for q, row, most in zip(range(low, low + len(away)), away, limit, strict=True):
            near = np.flatnonzero(~(row > most + 1e-9))
            dot = np.cumsum(x[near] * asked[q], axis=1)[:, -1]
            distance = 1.0 - dot / (x_norm[near] * asked_norm[q])
            best = np.lexsort((place[near], distance))[:k]
            yield q, near[best], distance[best]


def candidates(chunks: DataFrame, queries: DataFrame, k: int = POOL, document: str | None = None, own_document: str | None = None) -> DataFrame:
    """The k nearest active chunks of each query by cosine distance, with ``vector_rank``; ties to the smaller chunk_id.

    chunks: chunk_id, embedding, optional is_active, filename, and any others; queries: query_id, query_vector and any
    others. Every query meets every chunk of its length, by design; null and zero vectors are left out. Both are dealt
    in blocks of bounded size, by hashes of their ids; k rows of a query are kept of each block before the last shuffle.
    ``own_document`` names a column of the queries: each then meets the chunks of that file alone, dealt by file, too.
    """
    if "is_active" in chunks.columns:
        chunks = chunks.where("is_active")
    if document is not None:
        chunks = chunks.where(F.col("filename") == document)
    left, right = with_norms(chunks, "embedding"), with_norms(queries, "query_vector")
    sized = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d"))
    blocks = sized(left).select(blocks_of("n", "d")).first()[0]
    query_blocks = sized(right).select(F.greatest(blocks_of("n", "d"), F.ceil(F.col("n") / MOST_QUESTIONS))).first()[0]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    file, asked_of = (F.col("row.filename"), F.col(f"row.{own_document}")) if own_document else (F.lit(""), F.lit(""))
    left = left.select("*", file.alias("file"), dealt("row.chunk_id", blocks).alias("block"), every(query_blocks).alias("query_block"))
    right = right.select("*", asked_of.alias("file"), every(blocks).alias("block"), dealt("row.query_id", query_blocks).alias("query_block"))
    return nearest_met(left, right, ("file", "block", "query_block"), k)


def with_norms(rows: DataFrame, vector: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """``row`` (all other columns), ``v`` (the vector, in doubles) and ``norm``; null and zero vectors are left out."""
    wide = F.transform(vector, lambda x: x.cast("double")).alias("v")
    packed = F.struct(*(c for c in rows.columns if c != vector)).alias("row")
    return rows.select(packed, wide, norm(F.col(vector)).alias("norm"), *beside).where(F.col("norm") > 0)


def blocks_of(n: str, d: str) -> Column:
    """In how many blocks n vectors of d numbers are worked on, one at least."""
    a_block = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_NUMBERS) / F.col(d)))
    return F.greatest(F.lit(1), F.ceil(F.col(n) / a_block)).cast("int")


def nearest_met(left: DataFrame, right: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """The k nearest rows of ``left`` for each query of ``right`` (see ``with_norms``) among those of the same keys.

    Columns of both, ``distance`` and ``vector_rank``. Rows of equal keys are one task's work: the caller bounds them. A
    column that both have is the query's.
    """
    schema = StructType([StructField("chunk", left.schema["row"].dataType), StructField("query", right.schema["row"].dataType), StructField("distance", DoubleType())])

    def meet(block: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        lengths, asked_lengths = (pc.list_value_length(t.column("v")).to_numpy() for t in (block, asked))
        for d in np.intersect1d(lengths, asked_lengths):
            rows, queried = np.flatnonzero(lengths == d), np.flatnonzero(asked_lengths == d)
            ids = pc.struct_field(block.column("row").take(pa.array(rows)).combine_chunks(), "chunk_id")
            place = np.empty(len(rows), np.int64)
            place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(rows))
            x, q = _vectors(block.column("v"), rows), _vectors(asked.column("v"), queried)
            norms, asked_norms = block.column("norm").to_numpy()[rows], asked.column("norm").to_numpy()[queried]
            for i, near, distance in _nearest(x, norms, place, q, asked_norms, k):
                for column, values in zip(found, (rows[near], np.full(len(near), queried[i]), distance), strict=True):
                    column.append(values)
        chunk, query, distance = map(np.concatenate, found)
        columns = [block.column("row").take(pa.array(chunk)), asked.column("row").take(pa.array(query)), pa.array(distance, pa.float64())]
        return pa.table(columns, names=["chunk", "query", "distance"])

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    own = [F.col(f"chunk.{c}") for c in left.schema["row"].dataType.fieldNames() if c not in right.schema["row"].dataType.fieldNames()]
    met = met.select(*own, "query.*", "distance")
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return met.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)


def in_both_scopes(chunks: DataFrame, queries: DataFrame, k: int = POOL, own_document: str = "source_document") -> DataFrame:
    """The nearest chunks of each query among all documents, and among those of its own document; ``scope`` tells which."""
    everywhere = candidates(chunks, queries, k).withColumn("scope", F.lit("all_documents"))
    return everywhere.unionByName(candidates(chunks, queries, k, own_document=own_document).withColumn("scope", F.lit("document_scoped")))


def with_filenames(stored: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored chunks with the ``filename`` of their document, as ``candidates`` wants them; those of no document go."""
    names = documents.select(F.col("id").alias("document_id"), "filename")
    return stored.drop("filename").join(names, "document_id")


def embedded_questions(questions: DataFrame, provider, text: str = "question") -> DataFrame:
    """Questions with their ``query_vector``, embedded in batches where the rows are, failures tried again.

    A null question has a null vector.
    """
    from gridlore.operators.versions import BATCH, with_retry

    schema = StructType([*questions.schema.fields, StructField("query_vector", ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                found = iter(with_retry(provider, [t for t in texts if t is not None]))
                vectors = pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*part.schema.names, "query_vector"])

    return questions.mapInArrow(run, schema)


def without_own(pool: DataFrame, own: Column, k: int = POOL, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k nearest of a pool of k + 1 once each question's ``own`` row is gone, ranked anew."""
    order = Window.partitionBy(*by).orderBy("vector_rank")
    left = pool.where(~F.coalesce(own, F.lit(False)))
    return left.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)


def rescored(pool: DataFrame, question: Column, w: Weights = Weights(), by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The pool with similarity, both signals, final_score and hybrid_rank; ties keep the vector order."""
    wanted = dates(question)
    pool = pool.withColumns(
        {
            "similarity": 1.0 - F.col("distance"),
            "date_match": mentions_date(F.col("text"), wanted),
            "table_match": F.coalesce(is_table_question(question) & (F.col("chunk_type") == "table"), F.lit(False)),
        }
    )
    score = w.similarity * F.col("similarity") + w.date * F.col("date_match").cast("int") + w.table * F.col("table_match").cast("int")
    pool = pool.withColumn("final_score", score)
    order = Window.partitionBy(*by).orderBy(F.desc("final_score"), "vector_rank")
    return pool.withColumn("hybrid_rank", F.row_number().over(order))


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int = 5, pool: int = POOL, document: str | None = None, w: Weights = Weights()) -> DataFrame:
    """The k best of each query's pool. queries also hold ``question``."""
    return rescored(candidates(chunks, queries, pool, document), F.col("question"), w).where(F.col("hybrid_rank") <= k)


def report_rows(ranked: DataFrame) -> DataFrame:
    """Ranked candidates as nested rows of a report."""
    return ranked.select(
        "query_id", F.col("hybrid_rank").alias("rank"), "chunk_id", F.array("pdf_page_number_start", "pdf_page_number_end").alias("pages"),
        F.struct("similarity", "date_match", "table_match", "final_score").alias("score"), preview(F.col("text")).alias("preview"),
    )


# ------------------------------------------------------------------- grading


def page_in_range(start: Column, end: Column, page: Column) -> Column:
    """Whether the page lies in the range; false for a null page."""
    return F.coalesce(page.between(start, end), F.lit(False))


def ranges_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.coalesce((a0 <= b1) & (b0 <= a1), F.lit(False))


def page_hits(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Whether some candidate's PDF pages overlap each question's expected page; no expected page is no hit.

    ranked: query_id, pdf_page_number_start, pdf_page_number_end; questions: query_id, pdf_page_number. A question
    without candidates has no hit.
    """
    page = F.col("pdf_page_number")
    met = questions.select("query_id", "pdf_page_number").join(ranked.select("query_id", "pdf_page_number_start", "pdf_page_number_end"), "query_id", "left")
    overlap = ranges_overlap(F.col("pdf_page_number_start"), F.col("pdf_page_number_end"), page, page)
    return met.groupBy("query_id").agg(F.bool_or(overlap).alias("hit"))


def graded(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Ranked candidates with document_correct, page_correct, content_correct and correct.

    ranked: query_id, filename, pages and the full text; questions: id, source_document, expected_location,
    expected_content_keywords. Questions that are not eligible are left out.
    """
    eligible = questions.where(F.coalesce("retrieval_eval_eligible", F.lit(True))) if "retrieval_eval_eligible" in questions.columns else questions
    q = eligible.select(F.col("id").alias("query_id"), "source_document", F.col("expected_location.pdf_page_number").alias("page"), "expected_content_keywords")
    out = ranked.join(F.broadcast(q) if q.count() <= MOST_QUESTIONS else q, "query_id")
    out = out.withColumns(
        {
            "document_correct": F.coalesce(F.col("filename") == F.col("source_document"), F.lit(False)),
            "page_correct": page_in_range(F.col("pdf_page_number_start"), F.col("pdf_page_number_end"), F.col("page")),
            "content_correct": contains_all(F.col("text"), F.col("expected_content_keywords")),
        }
    )
    return out.withColumn("correct", F.col("document_correct") & F.col("page_correct") & F.col("content_correct")).drop("page", "source_document", "expected_content_keywords")


def skipped(questions: DataFrame) -> DataFrame:
    return questions.where(~F.coalesce("retrieval_eval_eligible", F.lit(True))).select("id", "eligibility_reason")


def hit_ranks(graded_rows: DataFrame, rank: str, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """First rank that is wholly correct, over the whole pool, and hits at 1, 3 and 5."""
    first = F.min(F.when(F.col("correct"), F.col(rank)))
    hit = lambda k: F.coalesce(F.col("hit_rank") <= k, F.lit(False)).alias(f"hit_at_{k}")
    return graded_rows.groupBy(*keys).agg(first.alias("hit_rank")).select(*keys, "hit_rank", hit(1), hit(3), hit(5))


def keyword_coverage(ranked: DataFrame, keywords: DataFrame, rank: str, k: int) -> DataFrame:
    """Share of each query's keywords that some text of rank k or better holds, and success against its threshold.

    keywords: query_id, keywords, threshold (null: 1). A query without keywords has coverage 0 and no success. Each text
    is read once, by an automaton over the keywords of all queries; only keywords that it holds become rows. Keywords
    past the bounds of ``keywords.vocabulary`` are joined with their query's texts.
    """
    each = keywords.select("query_id", F.coalesce("threshold", F.lit(1.0)).alias("threshold"), F.explode_outer("keywords").alias("keyword"))
    top = ranked.where(F.col(rank) <= k).select("query_id", "text")
    words = vocabulary(each)
    if words is None:
        held = each.join(top, "query_id").where(F.contains("text", F.col("keyword"))).select("query_id", "keyword")
    else:
        held = with_found(top, "text", words).select("query_id", F.explode("found").alias("keyword"))
        held = held.unionByName(top.where(F.col("text").isNotNull()).select("query_id", F.lit("").alias("keyword")))
    held = held.distinct().withColumn("holds", F.lit(True))
    met = each.join(held, ["query_id", "keyword"], "left").groupBy("query_id", "threshold", "keyword").agg(F.bool_or(F.coalesce("holds", F.lit(False))).alias("found"))
    out = met.groupBy("query_id", "threshold").agg((F.count_if("found") / F.count("*")).alias("coverage"), (F.count("keyword") > 0).alias("asked"))
    return out.select("query_id", "coverage", ((F.col("coverage") >= F.col("threshold")) & F.col("asked")).alias("success"))


def order_unchanged(ranked: DataFrame) -> DataFrame:
    """Whether the hybrid order of each query equals the vector order."""
    ids = lambda rank: F.transform(F.array_sort(F.collect_list(F.struct(rank, "chunk_id"))), lambda x: x["chunk_id"])
    return ranked.groupBy("query_id").agg((ids("hybrid_rank") == ids("vector_rank")).alias("unchanged"))


def wrong_document_rate(graded_rows: DataFrame, rank: str, k: int = 5) -> DataFrame:
    top = graded_rows.where(F.col(rank) <= k)
    return top.agg(F.count_if(~F.col("document_correct")).alias("wrong"), F.count("*").alias("candidates"), F.avg((~F.col("document_correct")).cast("int")).alias("rate"))


def similar_cases(cases: DataFrame, query: dict, k: int = 5, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """The k cases most like one: same event type, Jaccard of tags, cosine of embeddings (weights are ours).

    cases: case_id, event_type, tags array, embedding. Matching and differing fields are named.
    """
    tags = F.array(*map(F.lit, query["tags"])).cast("array<string>")
    shared = F.try_divide(F.size(F.array_intersect("tags", tags)), F.size(F.array_union("tags", tags)))
    vector = F.array(*map(F.lit, map(float, query["embedding"])))
    parts = {
        "event_type_match": (F.col("event_type") == query["event_type"]).cast("int"),
        "tag_similarity": F.coalesce(shared, F.lit(0.0)),
        "text_similarity": F.coalesce(1.0 - cosine_distance(F.col("embedding"), vector), F.lit(0.0)),
    }
    out = cases.withColumns(parts)
    score = sum((w * F.col(n) for w, n in zip(weights[1:], list(parts)[1:], strict=True)), weights[0] * F.col("event_type_match"))
    names = F.array(*(F.when(F.col(n) > 0, F.lit(n)) for n in parts))
    out = out.withColumns({"score": score, "matching": F.array_compact(names)})
    out = out.withColumn("differing", F.array_except(F.array(*map(F.lit, parts)), F.col("matching")))
    return out.orderBy(F.desc("score"), "case_id").limit(k).drop("embedding")
