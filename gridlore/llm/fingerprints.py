"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for each i, the polynomial hash of its first i code points modulo two primes. Any span's
hash follows from two entries, so span equality costs two lookups, and the longest common extension of two texts is
found by binary search. A fingerprint is a text's length, its full hash, the hashes of its prefixes and suffixes at
lengths that grow by a fixed ratio, and the hashes of spans between places that the content picks: the longest common
prefix and suffix of two texts follow from their fingerprints alone, by the same binary search over those lengths, and
equal content between them from their common spans, wherever these stand.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import slices

#: Two primes below 2**31, so that products fit 64 bits, and a base for each.
PRIMES = (2147483629, 2147483587)
BASES = (1000003, 1299709)
#: Lengths of the ladder in each doubling.
STEPS = 8
#: Spans of a text's finest level at most; each coarser level has about half as many.
SPANS = 64
#: Code points by which a place is picked, and the least length of a span but the last is 2**LEAST_SPAN.
GRAM, LEAST_SPAN = 8, 3

_U = np.uint64
_tables: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, or of the inverse base; kept and doubled."""
    p = PRIMES[which]
    base = pow(BASES[which], -1, p) if inverse else BASES[which]
    known = _tables.get((which, inverse))
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        known = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            known[filled : 2 * filled] = known[:filled] * _U(pow(base, filled, p)) % _U(p)
            filled *= 2
        _tables[which, inverse] = known
    return known


_ladder = np.unique(np.floor(2 ** (np.arange(0, 40 * STEPS) / STEPS)).astype(np.int64))


def ladder(n: int) -> np.ndarray:
    """The lengths at which a text of n code points is hashed: all small ones, then ``STEPS`` in each doubling."""
    return _ladder[: np.searchsorted(_ladder, n, "right")]


class PrefixHashes:
    """The modular prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
        self.n = len(points)
        self.sums = []
        for k, p in enumerate(PRIMES):
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * _powers(k, False, self.n + 1)[: self.n] % _U(p), out=total[1:])
            self.sums.append(total % _U(p))
        self._grams: np.ndarray | None = None

    def grams(self) -> np.ndarray:
        """A number for the ``GRAM`` code points from each place on, the same wherever they stand."""
        if self._grams is None:
            self._grams = _grams(self, 0, max(0, self.n - GRAM + 1))
        return self._grams

    def prefix(self, k: int, lengths: np.ndarray) -> np.ndarray:
        return self.sums[k][lengths]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hash of the span, the same wherever it stands."""
        return tuple(
            int((int(s[end]) + p - int(s[start])) % p * int(_powers(k, True, start + 1)[start]) % p)
            for k, (s, p) in enumerate(zip(self.sums, PRIMES, strict=True))
        )

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common run from the two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, start + mid) == other.span(other_start, other_start + mid):
                low = mid
            else:
                high = mid - 1
        return low


class Spliced:
    """The prefix hashes of ``first[:keep] + second[:take]``, read off the two texts' arrays."""

    def __init__(self, first: PrefixHashes, keep: int, second: PrefixHashes, take: int):
        self.first, self.keep, self.second, self.n = first, keep, second, keep + take

    def prefix(self, k: int, lengths: np.ndarray) -> np.ndarray:
        p, keep = _U(PRIMES[k]), self.keep
        head = self.first.sums[k][np.minimum(lengths, keep)]
        tail = self.second.sums[k][np.maximum(lengths - keep, 0)]
        return (head + tail * _powers(k, False, keep + 1)[keep] % p) % p

    def grams(self) -> np.ndarray:
        low, high = max(0, self.keep - GRAM + 1), min(self.keep, max(0, self.n - GRAM + 1))
        ends = self.first.grams()[:low], self.second.grams()[: max(0, self.n - self.keep - GRAM + 1)]
        return np.concatenate([ends[0], _grams(self, low, max(low, high)), ends[1]])


def _grams(text: PrefixHashes | Spliced, low: int, high: int) -> np.ndarray:
    p, at = _U(PRIMES[0]), np.arange(low, high)
    h = (text.prefix(0, at + GRAM) + p - text.prefix(0, at)) % p * _powers(0, True, high + 1)[low:high] % p
    h = h * _U(0x9E3779B97F4A7C15)
    return (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def _levels(text: PrefixHashes | Spliced) -> str:
    """``exponent/spans|spans|..``: the spans (``length.hash`` each) of the finest level, then of ever coarser ones.

    At exponent e, the next place is the one of the least gram among those between 2**e and 3 * 2**e after the last,
    so that texts of equal content soon pick equal places, whatever stands before. Texts of other lengths share the
    coarser levels.
    """
    n, exponent = text.n, LEAST_SPAN
    while n >> exponent > SPANS:
        exponent += 1
    grams, starts, sizes, step = text.grams(), [], [], 1 << exponent
    while n > 3 * step:
        place, size = 0, len(starts)
        starts.append(0)
        while n - place > 3 * step:
            place += step
            place += int(grams[place : place + 2 * step].argmin())
            starts.append(place)
        sizes.append(len(starts) - size)
        step *= 2
    if not sizes:
        return f"{exponent:x}/"
    begin = np.array(starts)
    end = np.append(begin[1:], n)
    end[end == 0] = n
    spans = [(text.prefix(k, end) + _U(p) - text.prefix(k, begin)) % _U(p) * _powers(k, True, n + 1)[begin] % _U(p) for k, p in enumerate(PRIMES)]
    hashes = _short(*spans)
    keys = [f"{m:x}.{hashes[8 * i : 8 * i + 8]}" for i, m in enumerate((end - begin).tolist())]
    cuts = np.cumsum([0, *sizes]).tolist()
    return f"{exponent:x}/{'|'.join(','.join(keys[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True))}"


def _short(a: np.ndarray, b: np.ndarray) -> str:
    """32 bits of each pair of hashes, as hex."""
    h = a * _U(0x9E3779B97F4A7C15) + b * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return (h >> _U(32)).astype(">u4").tobytes().hex()


def fingerprint(text: PrefixHashes | Spliced) -> str:
    """``length:hash:prefixes:suffixes:spans`` in hex; equal texts have equal fingerprints."""
    n, lengths = text.n, ladder(text.n)
    whole = np.array([n])
    heads, tails, full = [], [], []
    for k, p in enumerate(PRIMES):
        heads.append(text.prefix(k, lengths))
        total = text.prefix(k, whole)
        rest = (total + _U(p) - text.prefix(k, n - lengths)) % _U(p)
        tails.append(rest * _powers(k, True, n + 1)[n - lengths] % _U(p))
        full.append(int(total[0]))
    return f"{n:x}:{full[0]:08x}{full[1]:08x}:{_short(*heads)}:{_short(*tails)}:{_levels(text)}"


def _spans(levels: str, exponent: int, head: int, tail: int) -> list[tuple[int, int, str]]:
    """Start, end and key of each span of a level that stands neither in the head nor in the tail."""
    first, spans = levels.split("/")
    spans = spans.split("|")
    place, found = exponent - int(first, 16), []
    if place >= len(spans) or not spans[place]:
        return found
    start = 0
    for key in spans[place].split(","):
        end = start + int(key.partition(".")[0], 16)
        if end > head and start < tail:
            found.append((start, end, key))
        start = end
    return found


def _between(a: str, n: int, b: str, m: int, head: int, tail: int) -> int:
    """Code points of the first text between its head and tail that common spans cover."""
    exponent = max(int(x.partition("/")[0], 16) for x in (a, b))
    left = Counter(key for _, _, key in _spans(b, exponent, head, m - tail))
    covered = 0
    for start, end, key in _spans(a, exponent, head, n - tail):
        if left[key] > 0:
            left[key] -= 1
            covered += min(end, n - tail) - max(start, head)
    return covered


def likeness(a: str, b: str) -> float:
    """Share of the longer text that the common prefix, the common suffix and common spans cover, from two fingerprints.

    1 for equal fingerprints only, 0 if one text is empty and the other not. A common prefix or suffix counts as the
    largest ladder length that it reaches. A span counts as often as both texts hold it, wherever it stands.
    """
    if a == b:
        return 1.0
    n, _, heads, tails, spans = a.split(":")
    m, _, other_heads, other_tails, other_spans = b.split(":")
    n, m = int(n, 16), int(m, 16)
    short, long = min(n, m), max(n, m)
    ends = []
    for x, y in ((heads, other_heads), (tails, other_tails)):
        low, high = 0, min(len(x), len(y)) // 8  # so many rungs agree at least, at most
        while low < high:
            mid = (low + high + 1) // 2
            if x[8 * mid - 8 : 8 * mid] == y[8 * mid - 8 : 8 * mid]:
                low = mid
            else:
                high = mid - 1
        ends.append(int(_ladder[low - 1]) if low else 0)
    covered = sum(ends)
    if covered < short:
        covered += min(_between(spans, n, other_spans, m, *ends), _between(other_spans, m, spans, n, *ends))
    return min(covered, short, long - 1) / long


_LAST = -(2**63)
KINDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint each text of ``docs`` (doc_id, text) and its edited text, see ``KINDS``.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's, by descending doc_id; after the last comes the first, so a lone document follows itself. Null texts
    count as empty (likeness of two empty texts: 1). Null ids come last; rows that repeat an id stand in descending
    order of their texts. Other columns are not read.

    The documents are dealt once into ranges of ids; the first document of each range, one for each range, is also
    given to the range before, as the next of its last document.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(float(_LAST))).alias("place"),
    )
    cuts = sorted(set(rows.select("place").approxQuantile("place", [k / n for k in range(1, n)], 0.25 / n)))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        rows = Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(rows)
    else:
        rows = rows.withColumn("range", F.lit(0.0))
    rows = rows.withColumn("range", F.col("range").cast("int"))
    # One row a range, so at most n: its first document, and the range that stands before it (round about).
    firsts = rows.groupBy("range").agg(F.max("place").alias("place")).collect()
    order = sorted((r["range"] for r in firsts), reverse=True)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    if not firsts:
        return spark.createDataFrame([], KINDS)
    heads = F.broadcast(
        spark.createDataFrame([(r["range"], r["place"], before[r["range"]]) for r in firsts], "range int, place double, to int")
    )
    guests = rows.join(heads, ["range", "place"]).select("doc_id", "text", "place", F.col("to").alias("range"), F.lit(1).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(guests)
    ordered = dealt.repartition("range").sortWithinPartitions(
        "range", "guest", F.col("place").desc(), F.col("doc_id").desc_nulls_last(), F.col("text").desc()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for batch in slices(whole, 1):
                out: list[tuple] = []
                for doc, text, place, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    hashes = PrefixHashes(text)
                    now = (doc, text, place, guest, hashes, fingerprint(hashes))
                    if held is not None and held[2] == place and not held[3]:
                        out.append(_row(held, now))
                    held = now
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, _TYPES, strict=True)],
                    names=[k.split()[0] for k in KINDS.split(", ")],
                )

    return ordered.select("doc_id", "text", "range", "guest").mapInArrow(run, KINDS)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _row(held: tuple, following: tuple) -> tuple:
    doc, text, _, _, hashes, own = held
    _, other_text, _, _, other_hashes, other = following
    cut = hashes.n // 3
    keep, take = hashes.n - cut, min(cut, other_hashes.n)
    edited = fingerprint(Spliced(hashes, keep, other_hashes, take))
    sha = hashlib.sha256((text[:keep] + other_text[:take]).encode("utf-8", "surrogatepass")).hexdigest()
    return doc, hashes.n, sha, own, edited, likeness(own, edited), likeness(own, other)
