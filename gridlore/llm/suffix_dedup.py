"""Repeated passages by sparse suffix arrays.

A suffix is kept where a minimiser stands: among the word n-grams of any passage of ``PASSAGE`` words, the one of least
hash. Equal passages keep equal suffixes at equal places, so every repeat shows among the kept ones, about one word in
twenty. They are sorted by how they begin and compared with their neighbours; of a run that begins alike, each suffix is
extended to the left and to the right against the run's first one, word by word, as far as passages reach whose
minimiser it is. What that leaves open, passages that the first one does not have, is told by digests of whole passages.

A passage is redundant if it stands at an earlier place as well: in a document of smaller id, or before it in the same
one without overlap. Documents of the same words are handled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import dropped, free_name, grams, grams_at, mix, slices, staged, utf8, words

#: Words of the shortest repeat.
PASSAGE = 50
#: Words by which a kept suffix is sorted.
HEAD = 12
#: Suffixes of a run that are extended in one place; the first of a longer run is sent to several.
BLOCK = 4096
#: Documents of a task whose suffixes are known to be listed already; beyond, copies are listed again.
KNOWN = 500_000

_U = np.uint64
_PLACE_BITS = 32


def _spans(hashes: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the ``PASSAGE`` words from each place on, from the hashes of its n-grams."""
    total = np.full(len(at), seed, np.uint64)
    for k in [*range(0, PASSAGE - HEAD, HEAD), PASSAGE - HEAD]:
        total = mix(total ^ grams_at(hashes, at + k, HEAD))
    return total


def _kept(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a passage the place of its minimiser, and the hash of each n-gram."""
    heads = grams(hashes, HEAD)
    width = PASSAGE - HEAD + 1
    if len(heads) < width:
        return np.zeros(0, np.int64), heads
    least = (heads >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | (np.arange(len(heads), dtype=np.uint64) & _U((1 << _PLACE_BITS) - 1))
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: -(width - size)], least[width - size :])
    return (least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64), heads


def _digest(hashes: np.ndarray) -> bytes:
    """Of a document's words: documents of the same words share it."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    """A digest's beginning, as a signed number. Suffixes are listed under it; only whole digests make copies."""
    return int.from_bytes(digest[:8], "little", signed=True)


LISTED = "doc_id long, same long, digest binary, n_words long, n_chars long, heads array<long>, repeated array<long>"


def _listed(docs: DataFrame) -> DataFrame:
    """How each document's kept suffixes begin, each head once, and the heads that it has more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for whole in batches:
            for batch in slices(whole, 1):
                data, at = utf8(batch.column(1))
                _, _, hashes, word_at = words(data, at, False)
                minimiser, heads = _kept(hashes)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                out: list[list] = [[], [], [], [], []]
                for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
                    digest = _digest(hashes[a:b])
                    same = _short(digest)
                    own = again = np.zeros(0, np.uint64)
                    if b - a >= PASSAGE and same not in known:
                        own, times = np.unique(heads[np.unique(minimiser[a : b - PASSAGE + 1])], return_counts=True)
                        again = own[times > 1]
                        if len(known) < KNOWN:
                            known.add(same)
                    for column, x in zip(out, (same, digest, b - a, own.view(np.int64), again.view(np.int64)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())]
                    + [pa.array(chars[at[1:]] - chars[at[:-1]], pa.int64())]
                    + [pa.array(x, pa.list_(pa.int64())) for x in out[3:]],
                    names=[k.split()[0] for k in LISTED.split(", ")],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, LISTED)


def _like_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (head, same) in order, those whose neighbour before or after begins alike; repeats of a row count once."""
    held = None  # the last row so far, and whether it has been let through
    for batch in batches:
        if not batch.num_rows:
            continue
        head, same = (np.asarray(c) for c in batch.columns)
        passed = False
        if held is not None:
            head, same = np.concatenate([[held[0]], head]), np.concatenate([[held[1]], same])
            passed = held[2]
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (same[1:] != same[:-1])])
        head, same = head[new], same[new]
        like = np.zeros(len(head), bool)
        like[1:] = head[1:] == head[:-1]
        like[:-1] |= like[1:]
        held = (head[-1], same[-1], bool(like[-1]) or (passed and len(head) == 1))
        if passed:
            like[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(same[like]), pa.array(head[like])], names=["same", "head"])


CONTEXTS = "head long, block int, doc_id long, same long, place long, before int, words binary, starts binary, ends binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (doc_id, text, same, heads with their blocks) each suffix that begins so, for each of its blocks.

    ``words`` are hashes of all words of the passages whose minimiser it is, ``before`` of which stand before the suffix
    at ``place``; ``starts`` and ``ends`` are those passages' characters.
    """
    names = [k.split()[0] for k in CONTEXTS.split(", ")]
    for whole in batches:
        for batch in slices(whole, 1):
            data, at = utf8(batch.column(1))
            begin, end, hashes, word_at = words(data, at, False)
            minimiser, heads = _kept(hashes)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            out: list[list] = [[] for _ in names]
            rows = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for k, (doc, same, wanted) in enumerate(rows):
                a, b = int(word_at[k]), int(word_at[k + 1])
                if b - a < PASSAGE or _short(_digest(hashes[a:b])) != same:
                    continue
                blocks = {w["head"]: w for w in wanted}
                own = minimiser[a : b - PASSAGE + 1]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                last = np.append(first[1:], len(own)) - 1
                seen: set[int] = set()
                for low, high, p, head in zip((first + a).tolist(), (last + a).tolist(), own[first].tolist(), heads[own[first]].view(np.int64).tolist(), strict=True):
                    if (w := blocks.get(head)) is None:
                        continue
                    row = (doc, same, p - a, p - low, hashes[low : high + PASSAGE].tobytes())
                    row += ((chars[begin[low : high + 1]] - chars[at[k]]).tobytes(), (chars[end[low + PASSAGE - 1 : high + PASSAGE]] - chars[at[k]]).tobytes())
                    for block in range(w["blocks"]) if w["leads"] and head not in seen else (w["block"],):
                        for column, x in zip(out, (head, block, *row), strict=True):
                            column.append(x)
                    seen.add(head)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


MATCHES = "doc_id long, same long, place long, last long, start long, end long, source long, source_same long, source_start long, hash long, check long"


def _binary(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column of numbers, and n + 1 offsets into them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    size = np.dtype(kind).itemsize
    if offsets is None or data is None:
        return np.zeros(0, kind), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind), (at - at[0]) // size


def _alike(a: np.ndarray, b: np.ndarray, at: np.ndarray, other: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` in a and ``other`` in b on are alike, up to ``n``; ``step`` -1 counts them before these places."""
    most = int(n.max(initial=0))
    if not most:
        return np.zeros(len(n), np.int64)
    k = np.arange(most)
    inside = k < n[:, None]
    k = k if step > 0 else -1 - k
    same = inside & (a[np.where(inside, at[:, None] + k, 0)] == b[np.where(inside, other[:, None] + k, 0)])
    return np.where(same.all(axis=1), most, same.argmin(axis=1))


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From suffixes in order of head, block, document, text and place, what is redundant, and what is left to be told by digests.

    Redundant: passages from ``place`` to ``last`` that the run's first suffix has, too, and its source. Left open:
    single passages with their digest and no source. All suffixes of a batch are worked on at once.
    """
    names = [k.split()[0] for k in MATCHES.split(", ")]
    lead: pa.RecordBatch | None = None  # the first suffix of the run that goes on
    listed = False  # whether its own passages are listed, as is needed for repeats that overlap it
    for batch in batches:
        if not batch.num_rows:
            continue
        held = lead is not None
        if held:
            batch = pa.Table.from_batches([lead, batch]).combine_chunks().to_batches()[0]
        head, block, doc, same, place, before = (np.asarray(c).astype(np.int64) for c in batch.columns[:6])
        (own, own_at), (starts, starts_at), (ends, _) = _binary(batch.column(6), np.uint64), _binary(batch.column(7), np.int64), _binary(batch.column(8), np.int64)
        leads = np.concatenate([[True], (head[1:] != head[:-1]) | (block[1:] != block[:-1])])
        first = np.maximum.accumulate(np.where(leads, np.arange(len(head)), 0))
        over = ~leads & (doc == doc[first]) & (same == same[first]) & (place - place[first] < PASSAGE)
        x = np.flatnonzero(~leads & ~over)
        y, at, n = first[x], own_at + np.append(before, 0), np.diff(own_at)
        left = _alike(own, own, at[x], at[y], np.minimum(before[x], before[y]), -1)
        right = _alike(own, own, at[x], at[y], np.minimum((n - before)[x], (n - before)[y]), 1)
        # Words before the suffix, of passages that both have.
        most, least = left, np.maximum(PASSAGE - right, before[x] - np.diff(starts_at)[x] + 1)
        both = least <= most
        x, y, most, least = x[both], y[both], most[both], least[both]
        low, high = starts_at[x] + before[x] - most, starts_at[x] + before[x] - least
        found = [doc[x], same[x], place[x] - most, place[x] - least, starts[low], ends[high], doc[y], same[y], starts[starts_at[y] + before[y] - most]]

        # Every passage but those of first suffixes, unless one overlaps them, and those just found.
        count = np.where(leads, 0, np.diff(starts_at))
        again = np.unique(first[over])
        again = again[1:] if held and listed and len(again) and again[0] == 0 else again
        count[again] = np.diff(starts_at)[again]
        listed = bool(first[-1] in again) or (held and listed and first[-1] == 0)
        of = np.repeat(np.arange(len(head)), count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        least_of, most_of = np.ones(len(head), np.int64), np.zeros(len(head), np.int64)
        least_of[x], most_of[x] = least, most
        left_open = (before[of] - k < least_of[of]) | (before[of] - k > most_of[of])
        of, k = of[left_open], k[left_open]
        s, c = place[of] - before[of] + k, starts_at[of] + k
        digests = [_spans(own, own_at[of] + k, seed).view(np.int64) for seed in (0, 1)]

        none = lambda m: pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays([*map(pa.array, found), none(len(x)), none(len(x))], names=names)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (doc[of], same[of], s, s, starts[c], ends[c])), *[none(len(of))] * 3, *map(pa.array, digests)], names=names)
        lead = batch.slice(first[-1], 1)


SPANS = "doc_id long, start long, end long, n_words long, source_doc_id long, source_start long, text_digest long"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, same, place, last, start, end, source, source start), in order of text and place, to maximal spans."""
    held: list | None = None
    names = [k.split()[0] for k in SPANS.split(", ")]

    def out(rows: list[list]) -> pa.RecordBatch:
        made = [(d, s, e, q - p + PASSAGE, o, t, x) for d, x, p, q, s, e, o, t in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else [[]] * 7)], names=names)

    for batch in batches:
        done = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[:2] == list(row[:2]) and row[2] <= held[3] + PASSAGE:
                held[3], held[5] = max(held[3], row[3]), max(held[5], row[5])
            else:
                if held is not None:
                    done.append(held)
                held = list(row)
        yield out(done)
    if held is not None:
        yield out([held])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Redundant passages of ``docs`` (doc_id, text), see ``SPANS``; a document without any has no row.

    ``start`` and ``end`` are code points of the text; ``source_doc_id`` and ``source_start`` name an earlier place of
    the span's first ``PASSAGE`` words. A document of the same words as one of smaller id, and of ``PASSAGE`` words at
    least, is one span from 0 to its end. Null and shorter texts have no passage. Rows that repeat an id and its text
    count once; texts that share an id are judged each by itself, in the order of ``text_digest``, which tells whose a
    span is. Rows with a null id are left out. Other columns are not read. Texts of any length are taken whole.
    """
    return _repeats(docs)[0]


def _repeats(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``repeated_passages``, and the staged tables that it reads."""
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    listed = staged(_listed(docs), "suffixes")
    long = listed.where(F.col("n_words") >= PASSAGE)
    nodes = long.groupBy("same", "digest").agg(F.min("doc_id").alias("first"))

    suffixes = long.select(F.explode("heads").alias("head"), "same")
    alike = suffixes.repartition("head").sortWithinPartitions("head", "same").mapInArrow(_like_neighbours, "same long, head long")
    alike = alike.unionByName(long.select("same", F.explode("repeated").alias("head"))).distinct()
    alike = staged(alike.join(nodes, "same").select("head", "same", F.col("first").alias("doc_id")), "alike")
    runs = alike.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min(F.struct("doc_id", "same")).alias("lead"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")
    placed = alike.join(runs, "head").select("doc_id", "same", F.struct("head", block, "blocks", (F.struct("doc_id", "same") == F.col("lead")).alias("leads")).alias("head"))
    wanted = staged(placed.groupBy("doc_id", "same").agg(F.collect_list("head").alias("heads")), "heads")  # of one document each
    dropped(alike)
    # Merged at every size: left to itself, Spark sends the heads of small inputs to every executor.
    texts = docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "same", "heads").mapInArrow(_contexts, CONTEXTS)
    order = ("head", "block", "doc_id", "same", "place")
    matches = staged(texts.repartition("head", "block").sortWithinPartitions(*order).mapInArrow(_extended, MATCHES), "matches")
    dropped(wanted)

    open_ones = matches.where(F.col("hash").isNotNull())
    firsts = open_ones.groupBy("hash", "check").agg(F.min(F.struct("doc_id", "same", "place", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("hash", "check", F.col("first.doc_id").alias("source"), F.col("first.same").alias("source_same"), F.col("first.place").alias("source_place"), F.col("first.start").alias("source_start"))
    later = (F.col("doc_id") != F.col("source")) | (F.col("same") != F.col("source_same")) | (F.col("place") >= F.col("source_place") + PASSAGE)
    columns = ["doc_id", "same", "place", "last", "start", "end", "source", "source_start"]
    redundant = open_ones.drop("source", "source_same", "source_start").join(firsts, ["hash", "check"]).where(later).select(columns)
    redundant = redundant.unionByName(matches.where(F.col("hash").isNull()).select(columns))
    spans = redundant.repartition("doc_id").sortWithinPartitions("doc_id", "same", "place", "source").mapInArrow(_merged, SPANS)

    copies = long.join(nodes, ["same", "digest"]).where(F.col("doc_id") != F.col("first")).select(
        "doc_id", F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"), "n_words", F.col("first").alias("source_doc_id"), F.lit(0).cast("long").alias("source_start"), F.col("same").alias("text_digest")
    ).dropDuplicates(["doc_id", "text_digest"])
    return spans.unionByName(copies), [listed, matches]


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without redundant passages, in its own columns; a document of which nothing is left goes.

    ``n_chars``, if there is such a column, follows the text. Rows without a redundant passage stay as they are, also
    those with a null text or id. Of rows that repeat an id each loses the spans of its own text.
    """
    found, tables = _repeats(docs)
    spans_name, id_name = free_name(docs, "spans"), free_name(docs, "id")
    by_doc = staged(found.groupBy(F.col("doc_id").alias(id_name)).agg(F.collect_list(F.struct("start", "end", "text_digest")).alias(spans_name)), "spans")  # of one document each
    dropped(*tables)
    joined = docs.join(by_doc, F.col("doc_id") == F.col(id_name), "left")
    names = docs.columns
    kinds = dict(docs.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spans_at = names.index("text"), len(names)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = np.ones(len(texts), bool)
            chars = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for k, spans in enumerate(batch.column(spans_at).to_pylist()):
                if not spans or texts[k] is None:
                    continue
                _, _, hashes, _ = words(*utf8(batch.column(at).slice(k, 1)), False)
                own = _short(_digest(hashes))
                if spans := [s for s in spans if s["text_digest"] == own]:
                    texts[k] = _left(texts[k], spans)
                    keep[k] = texts[k] is not None
                    if chars is not None and keep[k]:
                        chars[k] = len(texts[k])
            columns = list(batch.columns[:spans_at])
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                columns[names.index("n_chars")] = pa.array(chars, columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    return joined.select(*(F.col(f"`{n}`") for n in names), spans_name).mapInArrow(cut, schema)


def _left(text: str, spans: list[dict]) -> str | None:
    """The text without its spans; None if nothing but white space is left."""
    kept, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] > at:
            kept.append(text[at : s["start"]])
        at = max(at, s["end"])
    left = "".join([*kept, text[at:]])
    return left if left.strip() else None
