"""Exact n-gram Jaccard join and its components, by PartEnum signatures (after Arasu, Ganti and Kaushik 2006).

Sets of similar size share a band. Two sets of a band with Jaccard similarity 3/4 differ in at most k elements, k being
a seventh of their sizes' sum. The domain is dealt into more than k partitions; a set's elements in a partition make
up one signature, so sets that differ in at most k elements agree on some partition. Of its signatures, in one order
for all sets, a set needs only the first k + 1: the first that both sets have is among them on either side.

Shingles that many texts share are left out of that domain, which is sound, since leaving elements out adds no
difference; a set with too few signatures left is also listed over finer partitions, and at last over the whole domain.
Equal sets are one node. The nodes of a signature are compared with its least node, the centre; so a large group of
near copies costs about one comparison for each of them. Only where a centre's nodes are not all in one component are
they compared with each other, in blocks of bounded size, and only those outside the centre's component with the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import dropped, free_name, grams, mix, slices, staged, utf8, words

#: Words of a shingle.
SHINGLE = 5
#: A shingle that so many nodes of a task share is reported, one reported for so many nodes in all is common.
SHARED_IN_TASK = 2
COMMON = 8
#: Common shingles that are left out of the first domain, the most frequent first. Any number gives the same result.
MOST_COMMON = 1 << 18
#: Nodes that a task knows as listed already; beyond, copies are listed again.
KNOWN = 500_000
#: So many times as many partitions are used for sets with few elements outside the common ones.
FINER = 8
#: Shingles whose counts a task keeps, and those that wait to be counted with them.
COUNTED = 3_000_000
WAITING = 500_000
#: Rows of one signature from which its nodes are passed on as they come.
LONG_RUN = 4096
#: Nodes in a block of a centre's nodes, and elements of the sets of such a block.
BLOCK = 1024
BLOCK_ELEMENTS = 1 << 20
#: Document ids up to which a list is broadcast; above, it is joined.
BROADCAST_IDS = 500_000

_U = np.uint64


@dataclass(frozen=True)
class Likeness:
    """Sets of ``width``-word shingles that are linked from a Jaccard similarity of ``percent`` on."""

    width: int = SHINGLE
    percent: int = 75

    def similar(self, n: int, m: int, shared: int) -> bool:
        """Whether two sets of n and m elements that share so many are linked."""
        return 100 * shared >= self.percent * (n + m - shared)

    def sizes_fit(self, n: int, m: int) -> bool:
        return 100 * min(n, m) >= self.percent * max(n, m)

    def sets(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The set of each text: sorted distinct hashes of its shingles; of all its words, if it has fewer than a shingle."""
        _, _, hashes, word_at = words(data, at, True)
        runs = grams(hashes, self.width)
        sets = []
        for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
            if b - a >= self.width:
                sets.append(np.unique(runs[a : b - self.width + 1]))
            else:
                sets.append(grams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        return sets

    def within_reach(self, n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        """Whether two sets' sizes and sketches leave room for a link; never false for sets that are linked.

        Two sets differ in at least as many elements as their counts do, bucket by bucket.
        """
        if not self.sizes_fit(n, m):
            return False
        x, y = x.astype(np.int32), y.astype(np.int32)
        while len(x) > len(y):
            x = np.minimum(x.reshape(-1, 2).sum(1), 255)
        while len(y) > len(x):
            y = np.minimum(y.reshape(-1, 2).sum(1), 255)
        return (100 + self.percent) * int(np.abs(x - y).sum()) <= (100 - self.percent) * (n + m)


#: The links of this operator.
LINKS = Likeness()


def node_of(elements: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """Two halves of a set's digest, as signed numbers. Equal sets are one node, named by the first half."""
    digest = hashlib.blake2b(elements.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _tokens(elements: np.ndarray, partitions: int, salt: int, empty: bool = False) -> np.ndarray:
    """One signature for each partition that holds elements (or for every partition)."""
    part = (mix(elements ^ _U(0x2545F4914F6CDD1D)) >> _U(32)) * _U(partitions) >> _U(32)
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    total = np.zeros(partitions, np.uint64) if empty else None
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    sums = np.add.reduceat(mix(elements)[order], first) if len(first) else np.zeros(0, np.uint64)
    places = ordered[first] if len(first) else np.zeros(0, np.uint64)
    if total is not None:
        total[places.astype(np.int64)] = sums
        places, sums = np.arange(partitions, dtype=np.uint64), total
    return mix(sums + mix(places * _U(0x9E3779B97F4A7C15) + _U(salt)))


def _first(tokens: np.ndarray, n: int) -> np.ndarray:
    return np.partition(tokens, n - 1)[:n] if len(tokens) > n else tokens


def partitions_of(band: int) -> int:
    """Partitions for the sets of 2**band elements and more: more than any difference within reach."""
    return max(2 << band, 4) if band <= 3 else -(-9 * (1 << band) // 10)


def signatures(elements: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The signatures of a non-empty set, for its own band and, where a similar set may be in it, for the one below."""
    n = len(elements)
    rare = elements
    if len(common):
        at = np.searchsorted(common, elements)
        rare = elements[common[np.minimum(at, len(common) - 1)] != elements]
    band = n.bit_length() - 1
    reach = [(band, (n + 4 * n // 3) // 7)]
    if band and -(-3 * n // 4) < (1 << band):
        reach.append((band - 1, (n + (1 << band) - 1) // 7))
    found = []
    for b, k in reach:
        partitions = partitions_of(b)
        # Each listing is for sets that have too few signatures in the one before it.
        for salt, domain, n_parts, empty in (
            (0, rare, partitions, False), (1, rare, FINER * partitions, False), (2, elements, partitions, False), (3, elements, partitions, True)
        ):
            own = _tokens(domain, n_parts, 4 * b + salt, empty)
            found.append(_first(own, k + 1))
            if len(own) > k:
                break
    return np.concatenate(found).view(np.int64)


class _Counts:
    """How many nodes of a task have each shingle; when there are too many, those met once so far are forgotten."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.waiting = 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def add(self, elements: np.ndarray) -> None:
        self.parts.append(elements)
        self.waiting += len(elements)
        if self.waiting > WAITING:
            self.settle()

    def settle(self) -> None:
        new, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.parts]), return_counts=True)
        self.parts, self.waiting = [], 0
        at = np.searchsorted(self.values, new)
        known = at < len(self.values)
        known[known] = self.values[at[known]] == new[known]
        self.counts[at[known]] += times[known].astype(np.int32)
        self.values = np.insert(self.values, at[~known], new[~known])
        self.counts = np.insert(self.counts, at[~known], times[~known])
        if len(self.values) > COUNTED:
            often = self.counts > 1
            self.values, self.counts = self.values[often], self.counts[often]


SETS = "doc_id long, n_shingles long, node long, check long"


def told_apart(sets_of: Callable[[int], DataFrame]) -> tuple[DataFrame, int]:
    """The staged sets of a salt under which no two different sets have one node, and the salt.

    Sets are told apart by 128 bits: where two share the node's half but not the other, the next salt is tried.
    """
    for salt in count():
        sets = staged(sets_of(salt), "sets")
        mixed = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
        if mixed.isEmpty():
            return sets, salt
        dropped(sets)
    raise AssertionError


def _sets(docs: DataFrame, salt: int) -> DataFrame:
    """Each document's set size and node; and, in a last row of each task (no n_shingles), its often shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        counts = _Counts()

        def out(ids: pa.Array, sizes: list, nodes: list, shared: list, times: list) -> pa.RecordBatch:
            columns = [ids, *(pa.array(x, pa.int64()) for x in (sizes, *zip(*nodes, strict=True))), *(pa.array(x, pa.list_(pa.int64())) for x in (shared, times))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "check", "shared", "times"])

        for whole in batches:
            for batch in slices(whole, 1):
                sizes, nodes = [], []
                for elements in LINKS.sets(*utf8(batch.column(1))):
                    sizes.append(len(elements))
                    nodes.append(node_of(elements, salt) if len(elements) else (None, None))
                    if len(elements) and nodes[-1][0] not in known:
                        counts.add(elements)
                        if len(known) < KNOWN:
                            known.add(nodes[-1][0])
                yield out(batch.column(0).cast(pa.int64()), sizes, nodes, [None] * len(sizes), [None] * len(sizes))
        counts.settle()
        often = counts.counts >= SHARED_IN_TASK
        yield out(pa.array([None], pa.int64()), [None], [(None, None)], [counts.values[often].view(np.int64)], [counts.counts[often].astype(np.int64)])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"{SETS}, shared array<long>, times array<long>")


def _common(sets: DataFrame) -> np.ndarray:
    """The most frequent of the shingles that tasks reported, at most ``MOST_COMMON``, in order."""
    each = sets.where(F.col("n_shingles").isNull()).select(F.explode(F.arrays_zip("shared", "times")).alias("x"))
    total = each.groupBy("x.shared").agg(F.sum("x.times").alias("n")).where(F.col("n") >= COMMON)
    rows = total.orderBy(F.desc("n"), "shared").limit(MOST_COMMON).select("shared").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def _listed(docs: DataFrame, common: np.ndarray, salt: int) -> DataFrame:
    """One row (signature, node) for each signature of each node, once for each task that holds the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for whole in batches:
            for batch in slices(whole, 0):
                found, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for elements in LINKS.sets(*utf8(batch.column(0))):
                    if not len(elements) or (node := node_of(elements, salt)[0]) in known:
                        continue
                    if len(known) < KNOWN:
                        known.add(node)
                    found.append(signatures(elements, common))
                    nodes.append(np.full(len(found[-1]), node, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(nodes))], names=["signature", "node"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "signature long, node long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (signature, node) in order, the nodes of each signature that several have: its least node, and each other.

    Signatures of the same nodes are passed on once. The nodes of a very frequent signature go through as they come.
    """
    seen: set[int] = set()
    signature, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    streaming, centre, last = None, 0, 0  # a long run under way: its signature, first and last node

    def out(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)]) for k in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["centre", "node"])

    def closed(signature: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        edge = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1], [True]]))
        size = np.diff(edge)
        many = np.flatnonzero(size > 1)
        if not len(many):
            return []
        mixed = np.concatenate([[_U(0)], np.cumsum(mix(node.view(np.uint64)))])
        group = mix(mixed[edge[many + 1]] - mixed[edge[many]] + size[many].astype(np.uint64)).tolist()
        rows = []
        for g, a, n in zip(group, edge[many].tolist(), size[many].tolist(), strict=True):
            if g not in seen:
                if len(seen) < KNOWN:
                    seen.add(g)
                rows.append((np.full(n - 1, node[a]), node[a + 1 : a + n]))
        return rows

    for batch in batches:
        signature = np.concatenate([signature, np.asarray(batch.column(0))])
        node = np.concatenate([node, np.asarray(batch.column(1))])
        if not len(signature):
            continue
        new = np.concatenate([[True], (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])])
        signature, node = signature[new], node[new]
        rows = []
        if streaming is not None:
            n = int(np.searchsorted(signature, streaming, "right"))
            more = node[:n][node[:n] != last]
            rows.append((np.full(len(more), centre), more))
            last = more[-1] if len(more) else last
            signature, node = signature[n:], node[n:]
            if not len(signature):
                yield out(rows)
                continue
            streaming = None
        open_at = int(np.searchsorted(signature, signature[-1], "left"))
        rows += closed(signature[:open_at], node[:open_at])
        signature, node = signature[open_at:], node[open_at:]
        if len(signature) > LONG_RUN:
            streaming, centre, last = int(signature[0]), node[0], node[-1]
            rows.append((np.full(len(node) - 1, centre), node[1:]))
            signature, node = signature[:0], node[:0]
        yield out(rows)
    yield out(closed(signature, node))


def sketch(elements: np.ndarray) -> bytes:
    """How many elements fall into each of as many buckets as the set's band has room for, up to 255 each."""
    band = len(elements).bit_length() - 1
    bucket = (mix(elements ^ _U(0xC2B2AE3D27D4EB4F)) >> _U(64 - band)).astype(np.int64) if band else np.zeros(len(elements), np.int64)
    return np.minimum(np.bincount(bucket, minlength=1 << band), 255).astype(np.uint8).tobytes()


def _near(links: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows (a, b, size and sketch of a, size and sketch of b) the pairs that may be similar."""
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            pairs = zip(n, batch.column(3), m, batch.column(5), strict=True)
            keep = [links.within_reach(i, np.frombuffer(x.as_buffer(), np.uint8), j, np.frombuffer(y.as_buffer(), np.uint8)) for i, x, j, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(links: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows (a, block, b, text) in order of a and block, the centre's own (no b) first, the pairs that are similar."""
        key, centre = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in slices(whole, 3):
                found: list[list[int]] = [[], []]
                rows = zip(*(batch.column(k).to_pylist() for k in range(3)), links.sets(*utf8(batch.column(3))), strict=True)
                for a, block, b, elements in rows:
                    if b is None:
                        key, centre = (a, block), elements
                    elif key == (a, block) and links.sizes_fit(len(centre), len(elements)):
                        few, many = sorted((centre, elements), key=len)
                        at = np.searchsorted(many, few)
                        if links.similar(len(few), len(many), int((many[np.minimum(at, len(many) - 1)] == few).sum())):
                            found[0].append(a)
                            found[1].append(b)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return run


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n numbers that each is joined with, directly or not, by the pairs (a, b)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        now = least.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == least).all():
            return least
        least = now


def _compared(links: Likeness):
    def run(block: pa.Table) -> pa.Table:
        """From rows (node, label, asks, text) of one block, links between labels of which asking nodes are similar to others.

        Overlaps are counted by matrix products over the elements that several of the nodes have. The labels that come
        together in a block are linked with the least of them, so links are fewer than labels.
        """
        sets = links.sets(*utf8(block.column("text")))
        label = block.column("label").to_numpy()
        asks = block.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, element, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
        owner, element = owner[times[element] > 1], element[times[element] > 1]
        order = np.argsort(element, kind="stable")
        owner, element = owner[order], element[order]
        rows, columns = np.flatnonzero(~asks), np.flatnonzero(asks)
        shared = np.zeros((len(columns), len(rows)), np.float32)
        wide = 2048
        for low in range(0, int(element[-1]) + 1 if len(element) else 0, wide):
            a, b = np.searchsorted(element, (low, low + wide))
            if a < b:
                held = np.zeros((len(sets), wide), np.float32)
                held[owner[a:b], element[a:b] - low] = 1
                shared += held[columns] @ held[rows].T
        union = size[columns][:, None] + size[rows][None, :] - shared
        i, j = np.nonzero((100 * shared >= links.percent * union) & (label[columns][:, None] != label[rows][None, :]))
        labels, of = np.unique(np.concatenate([label[columns[i]], label[rows[j]]]), return_inverse=True)
        least = _joined(len(labels), of[: len(i)], of[len(i) :])
        more = np.flatnonzero(least != np.arange(len(labels)))
        return pa.table({"a": pa.array(labels[more], pa.int64()), "b": pa.array(labels[least[more]], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): the least node that it reaches.

    Large-star and small-star steps (Kiveris et al. 2014) until nothing changes; each step writes its links.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        last = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(joined.select("a", F.col("least").alias("b"))).where("a <> b").distinct()
        edges = staged(small, "links")
        dropped(last)
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
    nodes = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), "b"))
    labels = staged(nodes.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")
    dropped(edges)
    return labels


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def sharing(listed: DataFrame) -> DataFrame:
    """Staged (centre, node) from rows (signature, node): the least node of each signature that several have, and each other."""
    ordered = listed.repartition("signature").sortWithinPartitions("signature", "node")
    return staged(ordered.mapInArrow(_groups, "centre long, node long").distinct(), "pairs")


def linked(docs: DataFrame, sets: DataFrame, pairs: DataFrame, likeness: Likeness, salt: int) -> DataFrame:
    """(node, label): a label for each node of ``pairs`` (see ``sharing``) that is linked with another of a signature of its.

    ``sets`` holds doc_id and node of the rows of ``docs``.
    """
    held = _texts_of(docs, sets, pairs, likeness, salt)
    named = lambda k: F.coalesce("label", k)
    # A node meets its least centre first; the others only if that has not brought them together.
    least = staged(pairs.groupBy("node").agg(F.min("centre").alias("least")), "least")
    links = _similar(least.select(F.col("least").alias("centre"), "node"), held, likeness)
    labels = components(links)
    of_node = pairs.join(least, "node").where("centre <> least").join(labels, "node", "left").select("centre", "node", named("node").alias("label"))
    apart = of_node.join(labels.select(F.col("node").alias("centre"), F.col("label").alias("own")), "centre", "left").where(F.col("label") != F.coalesce("own", "centre"))
    more = _similar(apart.select("centre", "node"), held, likeness)
    dropped(least)
    if not more.isEmpty():
        dropped(labels)
        links, before = staged(links.unionByName(more), "similar"), links
        dropped(before)
        labels = components(links)
    dropped(more)

    # Nodes of a centre that are not all of one component are compared with each other.
    sizes = held.select("node", "size")
    of_node = pairs.join(labels, "node", "left").join(sizes, "node").select("centre", "node", "size", named("node").alias("label"))
    of_both = of_node.join(labels.select(F.col("node").alias("centre"), F.col("label").alias("own")), "centre", "left").withColumn("own", F.coalesce("own", "centre"))
    mixed = of_both.groupBy("centre").agg(F.count("*").alias("n"), F.sum("size").alias("elements"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    needed = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    blocks = staged(mixed.select("centre", needed.alias("blocks")), "mixed")
    members = of_both.join(blocks, "centre").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = staged(members.select("centre", "node", "label", (F.col("label") != F.col("own")).alias("asks"), "blocks", "block"), "members")
    dropped(pairs, blocks)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = members.where("asks").select("centre", "node", "label", "asks", every.alias("row"), F.col("block").alias("column"))
    # Only columns in which a node asks are dealt the other nodes.
    columns = members.where("asks").groupBy("centre").agg(F.collect_set("block").alias("columns"))
    held_by = members.join(columns, "centre").select("centre", "node", "label", F.lit(False).alias("asks"), F.col("block").alias("row"), F.explode("columns").alias("column"))
    compared = held_by.unionByName(asking).join(held.select("node", "text").hint("merge"), "node").select("centre", "row", "column", "node", "label", "asks", "text")
    more = staged(compared.groupBy("centre", "row", "column").applyInArrow(_compared(likeness), "a long, b long"), "similar")
    dropped(members, held)
    if not more.isEmpty():
        dropped(labels)
        labels = components(links.unionByName(more))
    dropped(links, more)
    return labels


def _similar(pairs: DataFrame, held: DataFrame, likeness: Likeness) -> DataFrame:
    """Staged (a, b): the pairs (centre, node) that are similar. ``held``: see ``_texts_of``; texts are merged at every size."""
    held = held.hint("merge")
    sketches = lambda k, x: held.select(F.col("node").alias(k), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = pairs.join(sketches("centre", "x"), "centre").join(sketches("node", "y"), "node").select("centre", "node", "nx", "sx", "ny", "sy")
    near = staged(near.mapInArrow(_near(likeness), "a long, b long"), "near")

    # The text of a centre is sent once for each block of the nodes that are compared with it.
    blocks = near.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = staged(near.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b"), "dealt")
    dropped(near)
    others = dealt.join(held.select(F.col("node").alias("b"), "text"), "b").select("a", "block", "b", "text")
    centres = dealt.select("a", "block").distinct().join(held.select(F.col("node").alias("a"), "text"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    met = centres.unionByName(others).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    links = staged(met.mapInArrow(_verified(likeness), "a long, b long"), "similar")
    dropped(dealt)
    return links


def _texts_of(docs: DataFrame, sets: DataFrame, pairs: DataFrame, likeness: Likeness, salt: int) -> DataFrame:
    """node, size, sketch and text of one document for each node of ``pairs``."""
    wanted = pairs.select("node").union(pairs.select("centre")).distinct()
    firsts = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"))
    firsts = staged(firsts.select("node", F.col("first.doc_id").alias("doc_id")).join(wanted, "node", "left_semi"), "candidates")
    n = firsts.count()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                found = likeness.sets(*utf8(batch.column(0)))
                some = pa.array([len(x) > 0 for x in found], pa.bool_())
                found = [x for x in found if len(x)]
                columns = [pa.array([node_of(x, salt)[0] for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64())]
                columns += [pa.array(map(sketch, found), pa.binary()), batch.column(0).filter(some)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "sketch", "text"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        _small(firsts.select(F.col("doc_id").alias("__first")).distinct(), n), F.col("doc_id").eqNullSafe(F.col("__first")), "left_semi"
    )
    texts = texts.select("text").mapInArrow(sketched, "node long, size long, sketch binary, text string")
    held = staged(texts.join(_small(firsts.select("node"), n), "node", "left_semi"), "texts")
    if not held.groupBy("node").count().where("count > 1").isEmpty():  # rows that repeat an id and its text
        repeated, held = held, staged(held.dropDuplicates(["node"]), "texts")
        dropped(repeated)
    dropped(firsts)
    return held


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    A text's set is its distinct ``SHINGLE``-word shingles (A-Z lower-cased, words without white space), or all its
    words as one if it has fewer. Rows whose sets have Jaccard similarity 3/4 or more are linked; ``component_id`` is
    the least doc_id that links reach, the own one included. Null texts and texts without words have empty sets, are
    linked with nothing, and keep their own id. Repeated rows stay, linked with each other; a null id is larger than
    any other. Words and shingles are told apart by 64-bit hashes, sets by 128-bit digests. Other columns are not read.
    """
    return _components(docs)[0]


def _components(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``jaccard_components``, and the staged tables that it reads."""
    docs = docs.select("doc_id", "text")
    sets, salt = told_apart(lambda salt: _sets(docs, salt))
    labels = linked(docs, sets, sharing(_listed(docs, _common(sets), salt)), LINKS, salt)
    return named_components(sets, labels)


def named_components(sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, n_shingles, component_id for each row of ``sets``, and the staged tables that they read."""
    tables = [sets]
    sets = sets.where(F.col("n_shingles").isNotNull()).select("doc_id", "n_shingles", "node")
    nodes = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first")
    least = nodes.groupBy("label").agg(F.min("first").alias("component_id"))
    named = staged(nodes.join(least, "label").select("node", "component_id"), "components")
    dropped(labels)
    joined = sets.where(F.col("node").isNotNull()).join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = sets.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone), [*tables, named]


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, in its own columns, but for those that are linked with a row of smaller id.

    Rows that repeat an id stand or fall together; rows with a null id stay.
    """
    found, tables = _components(docs)
    name = free_name(docs, "other")
    others = staged(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct(), "others")
    dropped(*tables)
    return docs.join(_small(others, others.count()), F.col("doc_id") == F.col(name), "left_anti")
