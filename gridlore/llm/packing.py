"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents; a window (sequence) takes from every queue its target share of tokens. A queue's
share of a window is rarely whole, so its deficit is carried to the next window: after k windows each queue has been
served the floor of its exact due, to within a token. Because that carried sum has a closed form, a document's place
follows from the number of tokens before it in its queue alone. Tasks need no order among them: the deficits carry
across windows and partitions alike, and every window but the last is full.

Small sources share a queue. In it, a second schedule keeps their proportions to within a document: each source's
documents stand at evenly spaced places between 0 and 1, by the tokens before them in their source, and the queue is
sorted by these places, in ranges.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import slices, staged

#: A source with less than 1 / OWN_QUEUE of the documents shares the last queue with the others like it, by places.
OWN_QUEUE = 128
#: The least share of a window that a queue with tokens left gets is 1 / LEAST_SHARE, and about two tokens.
LEAST_SHARE = 1000
#: Rows (one for each task and queue) up to which the tasks' starting places are broadcast; above, they are joined.
BROADCAST_ROWS = 200_000
#: Entries of a task's table of distinct words.
TABLE_ENTRIES = 600_000


class Schedule:
    """Which tokens of each queue stand in which window.

    ``totals`` are the queues' tokens, ``weights`` their target shares (by default, the totals). While all queues have
    tokens the windows keep the target shares; when one runs out, the others share its room by their weights. A queue
    is dealt two tokens a window at least: with less than one, the floors of its due would not always grow. So a
    window has room for twice as many tokens as there are queues, or a ValueError says so.
    """

    def __init__(self, totals: list[int], window: int, weights: list[float] | None = None):
        self.window, self.total = window, sum(totals)
        w = list(totals) if weights is None else [max(1, round(x * (1 << 20))) for x in weights]
        scale = 1 + (1 << 30) // max(1, sum(w))  # so that whole numbers are fine enough
        w = [x * scale if t else 0 for x, t in zip(w, totals, strict=True)]
        if 2 * sum(x > 0 for x in totals) > window:
            raise ValueError(f"a window of {window} tokens has no room for two of each of {len(totals)} queues")
        least = 0
        while (more := -(-sum(w) // min(LEAST_SHARE, window // 2))) > least and least < max(w):
            least = more
            w = [max(x, least) if t else 0 for x, t in zip(w, totals, strict=True)]
        left, n = list(totals), len(totals)
        self.begins = [0]  # of each phase: tokens of all queues before it
        self.lengths: list[int] = []
        self.served = [[0] for _ in range(n)]  # by queue, before each phase
        self.shares: list[list[int]] = [[] for _ in range(n + 1)]  # by queue, in each phase: tokens of the queues before
        while any(left):
            first = min((i for i in range(n) if left[i]), key=lambda i: (left[i] / w[i], i))
            takes = [min(x, left[first] * w[i] // w[first]) for i, x in enumerate(left)]
            before = 0
            for i, take in enumerate(takes):
                self.shares[i].append(before)
                before += take
                left[i] -= take
                self.served[i].append(self.served[i][-1] + take)
            self.shares[n].append(before)
            self.lengths.append(before)
            self.begins.append(self.begins[-1] + before)

    def _at(self, queue: int, k: int) -> tuple[int, int]:
        """Tokens of the queue, and of all queues before it, in the first k windows."""
        g = min(k * self.window, self.total)
        p = min(bisect_right(self.begins, g) - 1, len(self.lengths) - 1)
        x, length = g - self.begins[p], self.lengths[p]
        low, high = x * self.shares[queue][p] // length, x * self.shares[queue + 1][p] // length
        base = 0 if len(self.lengths) == 1 else sum(self.served[i][p] for i in range(queue))
        return self.served[queue][p] + high - low, base + low

    def pieces(self, queue: int, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """Window, place in it, first and last token (exclusive) of each piece of the queue's tokens start .. end."""
        p = bisect_right(self.served[queue], start) - 1
        share = self.shares[queue + 1][p] - self.shares[queue][p]
        k = (self.begins[p] + (start - self.served[queue][p]) * self.lengths[p] // share) // self.window
        mine, before = self._at(queue, k)
        while mine > start:
            k -= 1
            mine, before = self._at(queue, k)
        while start < end:
            mine_next, before_next = self._at(queue, k + 1)
            if mine_next > start:
                stop = min(end, mine_next)
                yield k, before_next - before + start - mine, start, stop
                start = stop
            k, mine, before = k + 1, mine_next, before_next


class WordTable:
    """Byte-level BPE ids of texts, each distinct word encoded once, those that a text adds in one call.

    The pre-tokens of the vocabulary's pattern never cross a single space, or a line feed, between two characters that
    are no white space; texts with other runs of white space are encoded whole.
    """

    def __init__(self, ranks_file: str, pattern: str, width: int, entries: int = TABLE_ENTRIES, special: dict[str, int] | None = None):
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2") if width == 2 else np.dtype("<u4")
        self.entries = entries
        self.line_feed = ranks[b"\n"]
        self.special = {name: np.array([i], self.kind).tobytes() for name, i in (special or {}).items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self.opening: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the table, so that a worker that goes on with other work is no larger for it."""
        for table in (self.first, self.inner, self.opening):
            table.clear()

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), self.kind).tobytes()

    def _chunk(self, table: dict[str, bytes], lead: str, word: str) -> bytes | None:
        found = table.get(word)
        if found is None and word and not word[0].isspace() and not word[-1].isspace():
            found = self.whole(lead + word)
            if len(table) < self.entries // 2:
                table[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of the text; strings of special tokens in it are those tokens."""
        if not self.marks or not self.marks.search(text):
            return self._ordinary(text)
        parts, at = [], 0
        for m in self.marks.finditer(text):
            parts += [self._ordinary(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*parts, self._ordinary(text[at:])])

    def _many(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space, in one call: the pattern takes the line feeds between them for themselves."""
        ids = np.array(self.bpe.encode_ordinary(" " + "\n ".join(words)), self.kind)
        cuts, size, data = np.flatnonzero(ids == self.line_feed), self.kind.itemsize, ids.tobytes()
        if len(cuts) != len(words) - 1:
            return [self.whole(" " + w) for w in words]
        return [data[a:b] for a, b in zip([0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(data)], strict=True)]

    def _ordinary(self, text: str) -> bytes:
        parts: list[bytes | None] = []
        flat: list[str] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            first = self._chunk(self.opening if k else self.first, "\n" if k else "", words[0])
            if first is None:
                return self.whole(text)
            parts.append(first)
            parts += map(self.inner.get, words[1:])
            flat += words
        if None not in parts:
            return b"".join(parts)
        places, at = [], -1
        for _ in range(parts.count(None)):
            at = parts.index(None, at + 1)
            places.append(at)
        lacking = list(dict.fromkeys([flat[k] for k in places]))
        if not all(lacking) or any(w[0].isspace() or w[-1].isspace() for w in lacking):
            return self.whole(text)
        found = dict(zip(lacking, self._many(lacking), strict=True))
        for k in places:
            parts[k] = found[flat[k]]
        if room := max(0, self.entries // 2 - len(self.inner)):
            self.inner.update(found if len(found) <= room else islice(found.items(), room))
        return b"".join(parts)


_tables: dict[tuple, WordTable] = {}


def special_tokens(tokenizer_file: str) -> dict[str, int]:
    """The special tokens of a tokenizer's JSON file and their ids."""
    with open(tokenizer_file, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}


TOKENS = "part int, queue int, row long, source long, start long, n long, doc_id long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _key(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tokenised(docs: DataFrame, queues: dict[str, int], ranks_file: str, pattern: str, end_id: int, special: dict[str, int] | None = None) -> DataFrame:
    """Each document's ids, then ``end_id``, with its queue and the tokens before it in this task's share of the queue.

    In the last queue, ``start`` is the tokens before it in this task's share of its source. ``source`` is a hash.
    """
    last = len(queues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_file, tuple(sorted((special or {}).items())))
        if key not in _tables:
            _tables[key] = WordTable(ranks_file, pattern, 2, special=special)
        table = _tables[key]
        end = np.array([end_id], table.kind).tobytes()
        part, before, rows = TaskContext.get().partitionId(), [0] * last, 0
        earlier: dict[int, int] = {}  # by small source
        for whole in batches:
            for batch in slices(whole, 2):
                ids = [table.encode(t) + end for t in batch.column(2).to_pylist()]
                queue = [queues.get(s, last) for s in batch.column(1).to_pylist()]
                start, n = [], [len(b) // table.kind.itemsize for b in ids]
                for q, h, m in zip(queue, batch.column(3).to_pylist(), n, strict=True):
                    at, key = (before, q) if q < last else (earlier, h)
                    start.append(at[key] if q < last else at.get(key, 0))
                    at[key] = start[-1] + m
                columns = [pa.array([part] * len(n), pa.int32()), pa.array(queue, pa.int32()), pa.array(range(rows, rows + len(n)), pa.int64())]
                columns += [batch.column(3), pa.array(start, pa.int64()), pa.array(n, pa.int64()), batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())]
                rows += len(n)
                yield pa.RecordBatch.from_arrays(columns, names=[k.split()[0] for k in TOKENS.split(", ")])
        table.forget()

    rows = docs.select("doc_id", _key("source").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(_key("source")).alias("hash"))
    return rows.mapInArrow(run, TOKENS)


def shared_starts(tokens: DataFrame, queue: int) -> DataFrame:
    """part, row and the tokens before it in the queue, for each document of the queue that small sources share."""
    spark = tokens.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = tokens.where(F.col("queue") == queue).select("part", "row", "source", "start", "n")
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    of = Window.partitionBy("source")
    before = F.coalesce(F.sum("tokens").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "part", before.alias("before"), F.sum("tokens").over(of).alias("total"))
    # A hash of the source says where in its stretch a document stands, so that first documents do not come together.
    phase = F.pmod(F.xxhash64("source", F.lit(1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    place = (F.col("start") + F.col("before") + phase * F.col("n")) / F.col("total")
    placed = rows.join(sums, ["source", "part"]).select("part", "row", "source", "n", place.alias("place"))
    cut = F.least(F.floor(F.col("place") * ranges), F.lit(ranges - 1)).cast("int")
    placed = staged(placed.withColumn("range", cut), "places")
    starts, at = [], 0
    for r in placed.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # one row a range
        starts.append((r["range"], at))
        at += r["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "range int, first long"))
    order = Window.partitionBy("range").orderBy("place", "source", "part", "row").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.select("part", "row", "range", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("within"))
    return within.join(starts, "range").select("part", "row", (F.col("first") + F.col("within")).alias("start"))


def pack_documents(
    docs: DataFrame, ranks_file: str, pattern: str, window: int = 2048, end_id: int = 1, targets: dict[str, float] | None = None, special: dict[str, int] | None = None
) -> DataFrame:
    """Pack ``docs`` (doc_id, text, source) into sequences of ``window`` tokens; one row per piece, see ``PIECES``.

    Every id lies in exactly one piece; every sequence but the last is full. ``targets`` maps sources to their shares
    of each sequence (others: none until the named ones have run out, but for the least share); by default each source
    gets its share of all tokens. ``special`` maps strings in the texts to ids of their own. Sources beyond the
    ``OWN_QUEUE`` (and a fourth of ``window``) most frequent share a queue. A window too small for two tokens of each
    of ``targets`` is a ValueError. Null and empty texts are one ``end_id``; a null source is a source of its own name
    ''; rows are packed one by one, so repeated rows and ids are packed repeatedly. Other columns are not read.

    The ids are written once to the shared folder; only counts (one row for each task and queue) are summed up.
    """
    spark = docs.sparkSession
    sources = docs.groupBy(_key("source").alias("source")).agg(F.count("*").alias("rows"))
    total = docs.count()
    most = max(1, min(OWN_QUEUE, window // 4))
    named = [r["source"] for r in sources.where(F.col("rows") * most >= total).orderBy("source").collect()]  # at most so many
    if targets:
        named = sorted({*named, *targets})
    queues = {s: k for k, s in enumerate(named)}
    tokens = staged(tokenised(docs, queues, ranks_file, pattern, end_id, special), "tokens")
    shares = staged(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "shares")
    totals = [0] * (len(queues) + 1)
    for r in shares.groupBy("queue").agg(F.sum("n").alias("n")).collect():
        totals[r["queue"]] = r["n"]
    weights = [targets.get(s, 0.0) for s in named] + [0.0] if targets else None
    plan = Schedule(totals, window, weights)
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = shares.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if shares.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    columns = ["doc_id", "queue", "start", "n", "ids"]
    last = len(queues)
    placed = tokens.where(F.col("queue") < last).join(starts, ["part", "queue"]).withColumn("start", F.col("start") + F.col("before")).select(columns)
    if totals[last]:
        shared = tokens.where(F.col("queue") == last).drop("start").join(shared_starts(tokens, last), ["part", "row"])
        placed = placed.unionByName(shared.select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            out: list[list] = [[] for _ in range(7)]
            doc_ids, start, length, crc, doc_tokens, sequence, offset = out
            for doc, queue, begin, n, ids in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                for k, place, low, high in plan.pieces(queue, begin, begin + n):
                    doc_ids.append(doc)
                    start.append(low - begin)
                    length.append(high - low)
                    crc.append(zlib.crc32(wide[4 * (low - begin) : 4 * (high - begin)]))
                    doc_tokens.append(n)
                    sequence.append(k)
                    offset.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[k.split()[0] for k in PIECES.split(", ")])

    return placed.mapInArrow(run, PIECES)
