"""Runs of words that repeat with a period, by internal pattern matching.

A run of period q has a dyadic block (2^k words at a multiple of 2^k) among its first words, and the block occurs again q
words further on. Whether it does is asked of the suffix array of the text's words: the suffixes that begin with a block
are an interval of it, and a wavelet tree over the array tells the next of their places from a given word on (range
successor). Periods told by blocks of one size span twice as many places as the block has words; in windows of one block
length occurrences form an arithmetic progression, so that its first, second and last one tell them all. A progression
that goes on from the block itself only repeats its difference. Each candidate is extended word by word to both sides.

Many texts are worked on at once, with numpy; words of different texts count as different.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import slices, utf8, words

#: Words of the shortest run.
LEAST = 12


def classes(symbols: np.ndarray) -> list[np.ndarray]:
    """For windows of 1, 2, 4, ... symbols the place of the first equal one in sorted order, until all places differ.

    The last is the inverse of the suffix array. The last symbol, and every other that ends a text, occurs once.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], symbols[order[1:]] != symbols[order[:-1]]]))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    levels, width = [rank], 1
    unsettled = order[np.repeat(size > 1, size)]
    while len(unsettled):
        key = rank[unsettled] * n + rank[unsettled + width]
        at = np.argsort(key, kind="stable")
        unsettled, key = unsettled[at], key[at]
        old = rank[unsettled]
        place = np.arange(len(unsettled))
        new_one = np.concatenate([[True], key[1:] != key[:-1]])
        old_one = np.concatenate([[True], old[1:] != old[:-1]])
        rank = rank.copy()
        rank[unsettled] = old + np.maximum.accumulate(np.where(new_one, place, 0)) - np.maximum.accumulate(np.where(old_one, place, 0))
        levels.append(rank)
        unsettled = unsettled[~(new_one & np.append(new_one[1:], True))]
        width *= 2
    return levels


class WaveletTree:
    """Rank and selection by value over intervals of a sequence of numbers, level by level of their bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for b in reversed(range(bits)):
            one = (values >> b) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of [low, high) are less than the limit."""
        found = np.where(limit >> self.bits > 0, high - low, 0)
        inside = limit >> self.bits == 0
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            one = (limit >> b) & 1 == 1
            a, z = zeros[low], zeros[high]
            found += np.where(one & inside, z - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - z, z)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of [low, high) that has k smaller ones there."""
        value = np.zeros(len(k), np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, z = zeros[low], zeros[high]
            one = k >= z - a
            value |= one.astype(np.int64) << b
            k = np.where(one, k - (z - a), k)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - z, z)
        return value


def extended(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j on are equal; i and j differ."""
    total = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        total += (levels[k][i + total] == levels[k][j + total]).astype(np.int64) << k
    return total


def extended_back(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols before i and before j are equal; i < j."""
    total = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        a, b = i - total - (1 << k), j - total - (1 << k)
        total += ((a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])).astype(np.int64) << k
    return total


def distances(k: int, least: int) -> list[tuple[int, int]]:
    """Periods that blocks of 2^k words tell, in ranges of at most 2^k.

    A run of period q has max(least - q, q) words that stand again q further on; any 2^(k+1) - 1 words hold a block.
    """
    low, high, half = (2 << k) - 1, (4 << k) - 2, (least + 1) // 2
    ranges = [(max(1, least - high), min(half - 1, least - low)), (max(low, half), high)]
    return [(a, min(a + (1 << k) - 1, b)) for c, b in ranges for a in range(c, b + 1, 1 << k)]


def _occurrences(tree: WaveletTree, levels: list[np.ndarray], block: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, a: int, b: int):
    """(place, distance) of candidates: blocks of 2^k symbols that occur again a to b further on."""
    before = tree.below(low, high, block + a)
    count = tree.below(low, high, block + b + 1) - before
    some = count > 0
    block, low, high, before, count = block[some], low[some], high[some], before[some], count[some]
    if not len(block):
        return
    first = tree.nth(low, high, before)
    yield block, first - block
    several = np.flatnonzero(count > 1)
    if not len(several):
        return
    block, low, high, before, count, first = block[several], low[several], high[several], before[several], count[several], first[several]
    step = tree.nth(low, high, before + 1) - first
    pair = count == 2
    yield block[pair], (first + step - block)[pair]
    # A progression: its difference, and all of it unless it continues the block's own.
    block, step, count, first = block[~pair], step[~pair], count[~pair], first[~pair]
    yield block, step
    last = first + (count - 1) * step
    apart = block + step + extended(levels, block, block + step) < last + (1 << k)
    block, step, count, first = block[apart], step[apart], count[apart], first[apart]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    yield np.repeat(block, count), np.repeat(first - block, count) + nth * np.repeat(step, count)


def runs_of(hashes: np.ndarray, word_at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run, in this order, from word hashes and each text's offsets (n + 1)."""
    none = np.zeros(0, np.int64)
    n, texts = len(hashes), len(word_at) - 1
    if n < least:
        return none, none, none, none
    _, word = np.unique(hashes, return_inverse=True)
    text = np.repeat(np.arange(texts), np.diff(word_at))
    total, ends = n + texts, word_at[1:] + np.arange(texts)
    symbols = np.empty(total, np.int64)
    symbols[np.arange(n) + text] = text * (n + 1) + word
    symbols[ends] = np.arange(texts) * (n + 1) + n
    levels = classes(symbols)

    sizes = range(min(len(levels), total.bit_length()))
    told = [k for k in sizes if distances(k, least)]
    if not told:
        return none, none, none, none
    # Only suffixes that share a block's length with another are asked for.
    rank = levels[-1]
    suffix = np.empty(total, np.int64)
    suffix[rank] = np.arange(total)
    shared = levels[told[0]][suffix]
    like = np.zeros(total, bool)
    like[1:] = shared[1:] == shared[:-1]
    like[:-1] |= like[1:]
    compact = np.cumsum(like) - like
    tree = WaveletTree(suffix[like], int(total).bit_length())

    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in told:
        block = np.arange(0, total, 1 << k)
        begin = levels[k][block]
        size = np.bincount(levels[k], minlength=total)[begin]
        again = size > 1
        block, low = block[again], compact[begin[again]]
        for a, b in distances(k, least) if len(block) else ():
            found += _occurrences(tree, levels, block, low, low + size[again], k, a, b)
    place, period = (np.concatenate([none, *(f[c] for f in found)]) for c in range(2))
    start = place - extended_back(levels, place, place + period)
    length = place + period + extended(levels, place, place + period) - start
    long = length >= np.maximum(least, 2 * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # The same stretch is met with multiples of its period, too; the least is its own.
    own = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(start) else np.zeros(0, bool)
    start, length, period = start[own], length[own], period[own]
    at = np.searchsorted(ends, start)
    order = np.lexsort((period, start))
    return at[order], (start - np.concatenate([[0], ends + 1])[at])[order], length[order], period[order]


RUN = "struct<start: long, length: long, period: long>"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(text: bytes, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words left of a text, joined by one space: of each run its first period stays."""
    kept = text.split()  # at the same white space
    if len(start):
        depth = np.zeros(len(kept) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        kept = [w for w, d in zip(kept, np.cumsum(depth[:-1]).tolist(), strict=True) if not d]
    return b" ".join(kept)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (see ``RUN``, by start, then period) and ``collapsed`` for each row of ``docs`` (doc_id, text).

    A run is a stretch of words ``[^\\x20\\x09-\\x0D]+`` with smallest period q, of ``least`` and of 2 q words at least,
    that no neighbouring word extends. ``collapsed`` joins by one space the words that no run has after its first q. Null
    and empty texts have no words, no runs and an empty ``collapsed``; texts of any length are taken whole, in some 200
    bytes a word. Repeated rows give repeated results; an empty table gives none. Other columns are not read. Words are
    told apart, within a text, by 64-bit hashes.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                data, at = utf8(batch.column(1))
                _, _, hashes, word_at = words(data, at, False)
                text, start, length, period = runs_of(hashes, word_at, least)
                of = np.searchsorted(text, np.arange(batch.num_rows + 1))
                raw, edges = data.tobytes(), at.tolist()
                left = [_collapsed(raw[edges[k] : edges[k + 1]], *(x[of[k] : of[k + 1]] for x in (start, length, period))) for k in range(batch.num_rows)]
                rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(of, pa.int32()), rows).cast(_KIND)
                columns = [batch.column(0), pa.array(np.diff(word_at), pa.int64()), runs, pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
