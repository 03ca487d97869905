"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model holds a whitespace marker after another character, nor a line feed. So no merge crosses the
place before a marker that follows another character, nor a line feed, and a text may be segmented chunk by chunk:
each distinct marked word goes through the library once per task, its ids are joined back by position. The table
stays in the task: a table over the whole corpus would need a shuffle of every word occurrence.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import slices

#: Entries of a task's table. Words met after it is full are segmented for the slice of texts at hand and forgotten.
TABLE_ENTRIES = 600_000

_MARK = "▁"


class ChunkTable:
    """Encodes and decodes texts exactly as the model does, each distinct chunk once."""

    def __init__(self, model: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.entries = entries
        self.separable = not any(
            _MARK in (p := self.sp.id_to_piece(i)).lstrip(_MARK) or "\n" in p for i in range(self.sp.get_piece_size())
        ) and self.sp.encode("a") == self.sp.encode("a \n")[: len(self.sp.encode("a"))]
        self.line_feed = self.sp.encode("\n")[1:]
        self.passing: list[str] = []
        self.passing_opening: list[str] = []
        self.marked: dict[str, str] = {}  # a word after a marker
        self.opening: dict[str, str] = {}  # a line feed and the word right after it
        self.odd: dict[str, str] = {}  # chunks whose decoded form differs from their text
        self.alone: set[str] = set()  # words whose texts are encoded as a whole

    def learn(self, marked: set[str], opening: set[str]) -> None:
        for w in self.passing:
            self.marked.pop(w, None)
        for w in self.passing_opening:
            self.opening.pop(w, None)
        new = [w for w in marked if w not in self.marked]
        ids = self.sp.encode(new, num_threads=1)
        for w, each, back in zip(new, ids, self.sp.decode(ids, num_threads=1), strict=True):
            self.marked[w] = ",".join(map(str, each))
            if _MARK in w:
                self.alone.add(w)
            elif back != w:
                self.odd[" " + w] = " " + back
        first = [w for w in opening if w not in self.opening]
        ids = [each[1:] for each in self.sp.encode(["\n" + w for w in first], num_threads=1)]
        for w, each, back in zip(first, ids, self.sp.decode(ids, num_threads=1), strict=True):
            self.opening[w] = ",".join(map(str, each))
            if _MARK in w:
                self.alone.add(w)
            elif back != "\n" + w:
                self.odd["\n" + w] = back
        full = len(self.marked) + len(self.opening) > self.entries
        self.passing, self.passing_opening = (new, first) if full else ([], [])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids, in decimal and joined by commas, and its decoded form."""
        split = [[line.split(" ") for line in t.split("\n")] for t in texts]
        if self.separable:
            marked: set[str] = set()
            opening: set[str] = set()
            for lines in split:
                marked.update(lines[0])
                for line in lines[1:]:
                    opening.add(line[0])
                    marked.update(line[1:])
            collecting = gc.isenabled()
            gc.disable()  # the many short lists hold no cycles
            try:
                self.learn(marked, opening)
            finally:
                if collecting:
                    gc.enable()
        for text, lines in zip(texts, split, strict=True):
            whole = not self.separable or text == ""
            parts: list[str] = []
            for k, line in enumerate(lines):
                if whole:
                    break
                if k:
                    parts.append(self.opening[line[0]])
                    line = line[1:]
                parts += map(self.marked.__getitem__, line)
                whole = "" in line
            if whole or self.alone and any(w in self.alone for line in lines for w in line if w):
                ids = self.sp.encode(text)
                yield ",".join(map(str, ids)), self.sp.decode(ids)
                continue
            back = text
            if self.odd:
                pieces = [
                    ("\n" if k and not j else " ") + w for k, line in enumerate(lines) for j, w in enumerate(line)
                ]
                back = "".join(self.odd.get(p, p) for p in pieces)[1:]
            yield ",".join(parts), back


_tables: dict[str, ChunkTable] = {}


def chunk_table(model: str) -> ChunkTable:
    """The table of this Python worker."""
    if model not in _tables:
        _tables[model] = ChunkTable(model)
    return _tables[model]


def encode_documents(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) encoded and decoded: doc_id, ids, decoded, n_tokens, ids_sha256, decoded_sha256.

    One row per input row; a null text counts as empty and has no ids. Repeated rows stay repeated, other columns
    are not read. Without ``with_ids`` the columns ids and decoded are left out. No shuffle.
    """
    kinds = "doc_id long, " + "ids array<int>, decoded string, " * with_ids
    kinds += "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        for whole in batches:
            for batch in slices(whole, 1):
                out: dict[str, list] = {"n": [], "i": [], "d": [], "ids": [], "text": []}
                for ids, back in table.encode([t or "" for t in batch.column(1).to_pylist()]):
                    out["n"].append(ids.count(",") + 1 if ids else 0)
                    out["i"].append(hashlib.sha256(ids.encode()).hexdigest())
                    out["d"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        out["ids"].append(np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32))
                        out["text"].append(back)
                columns = [batch.column(0).cast(pa.int64())]
                names = ["doc_id"]
                if with_ids:
                    columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["text"], pa.string())]
                    names += ["ids", "decoded"]
                columns += [pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, kinds)
