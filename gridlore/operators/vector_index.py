"""Indexed vector search: inverted lists around coarse centres.

Centres are fitted on a bounded sample of directions; every row is then in the list of its nearest centre. A query meets
the lists of the centres nearest to it. How many, is calibrated on the sample, where neighbours are known; or lists are
met until no other can hold a nearer row (``exact``), which the largest angle between a centre and its rows tells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions.vectors import norm
from gridlore.operators.retrieval import MOST_QUESTIONS, POOL, blocks_of, nearest_met, with_norms

#: Rows of the sample, and numbers of its vectors; whichever is fewer.
SAMPLE, SAMPLE_NUMBERS = 65_536, 1 << 22
#: Most centres, and sampled rows for each of them at least.
MOST_CENTRES, ROWS_A_CENTRE = 4096, 16
ROUNDS = 12
#: Sampled rows whose neighbours in the sample are known, and the share of those that the calibrated lists hold.
ASKED, ENOUGH = 512, 0.97


@dataclass(frozen=True)
class Centres:
    """Unit vectors, how many lists a query meets, and the largest angle in each list (where known)."""

    vectors: np.ndarray
    probes: int
    radii: np.ndarray | None = None


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each unit vector (ties to the first), and its cosine."""
    like = x @ centres.T
    best = like.argmax(1)
    return best, like[np.arange(len(x)), best]


def fit(vectors: DataFrame, key: str, vector: str = "embedding", centres: int | None = None, k: int = POOL) -> Centres:
    """Centres from a sample of ``vectors``: the rows of least hash of their key, ``SAMPLE`` at most, of the commonest length.

    As many centres as the square root of all rows, within the bounds above. ``probes`` is the least number of lists that
    holds ``ENOUGH`` of the k nearest sampled neighbours of sampled rows; all rows lie denser than the sample, and so
    nearer.
    """
    rows = vectors.where(norm(F.col(vector)) > 0)
    lengths = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return Centres(np.zeros((1, 1)), 1)
    d, n = lengths["d"], lengths["n"]
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // d))
    drawn = rows.where(F.size(vector) == d).select(F.xxhash64(key).alias("h"), key, F.transform(vector, lambda x: x.cast("double")).alias("v")).orderBy("h", key).limit(most).toArrow()
    sample = _unit(drawn.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
    count = centres or max(1, min(MOST_CENTRES, len(sample) // ROWS_A_CENTRE, int(n**0.5)))
    found = sample[:count].copy()  # in the order of hashes, that is, at random
    for _ in range(ROUNDS):
        of, _ = _closest(sample, found)
        sums = np.zeros_like(found)
        np.add.at(sums, of, sample)
        size = np.linalg.norm(sums, axis=1)
        found[size > 0] = sums[size > 0] / size[size > 0, None]
    return Centres(found, _calibrated(sample, found, k))


def _calibrated(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    of, _ = _closest(sample, centres)
    asked = sample[:: max(1, len(sample) // ASKED)][:ASKED]
    like = asked @ sample.T
    near = np.argsort(-like, axis=1, kind="stable")[:, 1 : k + 1]  # the first is the row itself
    if not near.size:
        return len(centres)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each centre among a query's
    needed = np.take_along_axis(place, of[near], axis=1) + 1
    return int(np.quantile(needed, ENOUGH, method="higher"))


def in_lists(chunks: DataFrame, centres: Centres) -> DataFrame:
    """``chunks`` with ``list``, the number of the nearest centre, and ``angle`` to it. No shuffle.

    Null and zero vectors, and those of another length than the centres, are left out.
    """
    at, d = chunks.columns.index("embedding"), centres.vectors.shape[1]
    vectors = centres.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            of, like = _closest(_unit(flat), vectors) if len(flat) else (np.zeros(0, np.int64), np.zeros(0))
            columns = [*batch.columns, pa.array(of, pa.int32()), pa.array(np.arccos(np.clip(like, -1, 1)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "list", "angle"])

    usable = chunks.where((F.size("embedding") == d) & (norm(F.col("embedding")) > 0))
    schema = T.StructType([*chunks.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return usable.mapInArrow(run, schema)


def with_radii(listed: DataFrame, centres: Centres) -> Centres:
    """The centres with each list's largest angle, which ``exact`` searches need; one number for each centre."""
    radii = np.zeros(len(centres.vectors))
    for row in listed.groupBy("list").agg(F.max("angle").alias("a")).collect():
        radii[row["list"]] = row["a"]
    return replace(centres, radii=radii)


def _met_lists(asked: DataFrame, centres: Centres, probes: int, beyond: bool) -> DataFrame:
    """Queries (query_vector, ...) once for each ``list`` to meet: the ``probes`` nearest, or the others within ``reach``."""
    at, vectors, radii, d = asked.columns.index("query_vector"), centres.vectors, centres.radii, centres.vectors.shape[1]
    names = asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            for low in range(0, batch.num_rows, 1024):
                like = _unit(flat[low : low + 1024]) @ vectors.T
                order = np.argsort(-like, axis=1, kind="stable")
                chosen = np.zeros(like.shape, bool)
                np.put_along_axis(chosen, order[:, :probes], True, axis=1)
                if beyond:
                    reach = batch.column(names.index("reach")).to_numpy(zero_copy_only=False)[low : low + 1024]
                    chosen = ~chosen & (np.arccos(np.clip(like, -1, 1)) - radii <= reach[:, None] + 1e-6)
                row, of = np.nonzero(chosen)
                part = batch.slice(low, len(like)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of, pa.int32())], names=[*names, "list"])

    usable = asked.where((F.size("query_vector") == d) & (norm(F.col("query_vector")) > 0))
    return usable.mapInArrow(run, T.StructType([*asked.schema.fields, T.StructField("list", T.IntegerType())]))


def _searched(listed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of the lists that queries meet, in blocks of both of bounded size; a long list is several blocks."""
    chunks = listed.drop("angle")
    left, right = with_norms(chunks, "embedding", ("list",)), with_norms(asked, "query_vector", ("list",))
    sizes = listed.groupBy("list").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).select(F.col("list").alias("__list"), blocks_of("n", "d").alias("blocks"))
    sizes = F.broadcast(sizes)  # a row for each centre
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    queries = right.groupBy("list").agg(F.ceil(F.count("*") / MOST_QUESTIONS).cast("int").alias("query_blocks")).select(F.col("list").alias("__asked"), "query_blocks")
    queries = F.broadcast(queries)
    left = left.join(sizes, F.col("list") == F.col("__list")).join(queries, F.col("list") == F.col("__asked"))
    left = left.select("row", "v", "norm", "list", dealt("row.chunk_id", F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"))
    right = right.join(sizes, F.col("list") == F.col("__list")).join(queries, F.col("list") == F.col("__asked"))
    right = right.select("row", "v", "norm", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), dealt("row.query_id", F.col("query_blocks")).alias("query_block"))
    return nearest_met(left, right, ("list", "block", "query_block"), k)


def search(listed: DataFrame, queries: DataFrame, centres: Centres, k: int = POOL, probes: int | None = None, exact: bool = False) -> DataFrame:
    """The k nearest chunks of each query as ``retrieval.candidates`` gives them, of the lists that it meets.

    ``listed``: ``in_lists`` of the chunks, best stored; queries: query_id, query_vector and any others. ``exact`` meets
    further lists as long as they may hold a nearer row, and wants ``with_radii``: the result is then that of all rows.
    Inactive chunks are left out, as in ``candidates``.
    """
    if exact and centres.radii is None:
        raise ValueError("an exact search wants centres with radii")
    if "is_active" in listed.columns:
        listed = listed.where("is_active")
    probes = min(probes or centres.probes, len(centres.vectors))
    first = _searched(listed, _met_lists(queries, centres, probes, False), k)
    if not exact:
        return first.drop("list")
    # A query's worst of k so far; with fewer than k any row may come.
    worst = first.groupBy("query_id").agg(F.max("distance").alias("worst"), F.count("*").alias("found"))
    reach = F.when(F.col("found") == k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - F.col("worst"))))).otherwise(F.lit(10.0))
    asked = queries.join(worst, "query_id", "left").withColumn("reach", F.coalesce(reach, F.lit(10.0))).select(*queries.columns, "reach")
    more = _searched(listed, _met_lists(asked, centres, probes, True), k).drop("reach")
    return best_of(first.drop("list").unionByName(more.drop("list")), k)


def best_of(pools: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query's rows, ranked anew; ties to the smaller chunk_id."""
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return pools.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)
