"""Near duplicates by min-max hashing.

A permutation of all shingles is evaluated once and gives two values of a set: its least and its greatest element. Either
agrees for two sets with a probability equal to their Jaccard similarity, so half as many permutations make as many
values; a set does not often agree by both at once, which makes estimates vary less than those of as many minima. Bands
take ``ROWS`` permutations, once their minima, once their maxima: sets that agree in a band are candidates, and links
are confirmed on full sets.

Sets of similarity 0.8 share none of the 44 bands with a probability of (1 - 0.8^5)^44, or 3 in 100 million; that of
more similar ones is less. Equal sets always meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import dropped, mix, slices, utf8
from gridlore.llm.jaccard_partenum import KNOWN, SETS, Likeness, linked, named_components, node_of, sharing, told_apart

#: Two-word shingles, linked from a Jaccard similarity of 0.8 on.
LINKS = Likeness(width=2, percent=80)
#: Permutations of a band, and of all bands; each permutation is in two bands.
ROWS = 5
PERMUTATIONS = 110
#: Bytes of text whose sets are hashed at once: the shingles of a slice stay in a core's cache.
SLICE_BYTES = 1 << 17

_U = np.uint64


def multipliers(n: int = PERMUTATIONS) -> np.ndarray:
    """Odd numbers: multiplication modulo 2^64 by one permutes the mixed shingle hashes."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def extremes(sets: list[np.ndarray], permutations: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of each non-empty set under each permutation: two arrays (permutation, set)."""
    elements = mix(np.concatenate(sets))
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets[:-1]])]).astype(np.int64)
    low, high = (np.empty((len(permutations), len(sets)), np.uint64) for _ in range(2))
    permuted = np.empty_like(elements)
    for k, m in enumerate(permutations):
        np.multiply(elements, m, out=permuted)
        np.minimum.reduceat(permuted, first, out=low[k])
        np.maximum.reduceat(permuted, first, out=high[k])
    return low, high


def bands(sets: list[np.ndarray], permutations: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One signature for each band of each non-empty set: an array (set, band), minima before maxima."""
    found = []
    for side, values in enumerate(extremes(sets, permutations)):
        for band, low in enumerate(range(0, len(permutations), rows)):
            total = np.full(len(sets), _U(2 * band + side + 1))
            for value in values[low : low + rows]:
                total = mix(total * _U(0xD6E8FEB86659FD93) + value)
            found.append(total)
    return np.stack(found, axis=1)


def estimate(a: np.ndarray, b: np.ndarray, permutations: np.ndarray) -> float:
    """Estimated Jaccard similarity of two non-empty sets: the share of minima and maxima in which they agree."""
    low, high = extremes([a, b], permutations)
    return float(np.mean(np.concatenate([low[:, 0] == low[:, 1], high[:, 0] == high[:, 1]])))


def _signed(docs: DataFrame, salt: int, permutations: np.ndarray, rows: int) -> DataFrame:
    """Each row's set size, node and bands; a node's bands once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                sets = LINKS.sets(*utf8(batch.column(1)))
                nodes = [node_of(x, salt) if len(x) else (None, None) for x in sets]
                new = []
                for k, (node, _) in enumerate(nodes):
                    if node is not None and node not in known:
                        new.append(k)
                        if len(known) < KNOWN:
                            known.add(node)
                signed: list = [None] * len(sets)
                if new:
                    for k, row in zip(new, bands([sets[k] for k in new], permutations, rows).view(np.int64), strict=True):
                        signed[k] = row
                columns = [batch.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64())]
                columns += [pa.array([x[half] for x in nodes], pa.int64()) for half in range(2)] + [pa.array(signed, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "check", "bands"])

    return docs.mapInArrow(run, f"{SETS}, bands array<long>")


def minmax_components(docs: DataFrame, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    A text's set is its distinct two-word shingles (A-Z lower-cased, words without white space), or all its words as one
    if it has fewer. Rows whose sets have Jaccard similarity 0.8 or more, as counted on the full sets of those that share
    a band, are linked; ``component_id`` is the least doc_id that links reach, the own one included; ``kept`` tells
    whether the row has that id. Null texts and texts without words have empty sets, are linked with nothing, and keep
    their own id. Repeated rows stay, linked with each other; a null id is larger than any other, and kept where it is
    alone. An empty table stays empty. Other columns are not read; texts of any length are taken whole. Words and
    shingles are told apart by 64-bit hashes, sets by 128-bit digests.
    """
    found, _ = _components(docs, permutations, rows)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components(docs: DataFrame, permutations: int, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by = multipliers(permutations)
    signed, salt = told_apart(lambda salt: _signed(docs, salt, by, rows))
    pairs = sharing(signed.select(F.explode("bands").alias("signature"), "node"))
    return named_components(signed, linked(docs, signed, pairs, LINKS, salt))


def keep_originals(docs: DataFrame, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, in its own columns, but for those that are linked with a row of smaller id.

    Rows that repeat an id stand or fall together; rows with a null id stay.
    """
    from gridlore.llm.common import free_name, staged

    found, tables = _components(docs, permutations, rows)
    name = free_name(docs, "other")
    others = staged(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct(), "others")
    dropped(*tables)
    return docs.join(others, F.col("doc_id") == F.col(name), "left_anti")
