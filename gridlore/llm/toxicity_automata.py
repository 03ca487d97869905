"""Toxicity scores from a learnt lexicon, matched through Levenshtein automata.

The lexicon holds words that stand in far more toxic texts than others, and beginnings of words that do, so that other
endings of a term are met, too. Words are kept as a trie; a word of a text is run through the intersection of the trie
with the word's Levenshtein automaton, so terms misspelled by one edit are met as well. Each meeting is weighed by its
context window: inside quotation marks, or after a word of reporting, it counts as a quotation, elsewhere as abuse. A
logistic model over these sums gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import crc_of_id, slices, staged

#: About so many toxic and other texts, drawn by a hash of the id, are learnt from.
TOXIC_TEXTS = 4000
OTHER_TEXTS = 8000
#: Most terms of the lexicon, the strongest first.
TERMS = 3000
#: A term is at least so many times as frequent in toxic texts.
RATIO = 20.0
#: The same for beginnings of words, which other words have by chance; how often they are met then tells.
STEM_RATIO = 4.0
#: Shortest term that is also met misspelled.
FUZZY_LENGTH = 5
#: Letters of the beginnings of words that may be terms, the longest first.
STEMS = (7, 6, 5, 4)
#: Words before and after a term that make up its context window.
CONTEXT = 6
#: Entries of a task's table of words already looked up.
TABLE_ENTRIES = 600_000

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_QUOTES = "\"“”„«»‹›"
#: Words that report speech.
_REPORTING = frozenset("said says wrote writes quoted quote called according dit dijo sagte".split())


def clean(word: str) -> str:
    """Lower case, without marks at either end."""
    return _EDGES.sub("", word.lower())


def gapped(word: str) -> list[str]:
    """The word without each of its letters."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class Trie:
    """Terms as nested dicts; '' marks the end of a term and holds it."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.gaps: set[str] = set()
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            if len(term) >= FUZZY_LENGTH:
                self.gaps.add(term)
                self.gaps.update(gapped(term))

    def possible(self, word: str) -> bool:
        """Whether a term may be one edit away: then the two agree once each has lost a letter at most."""
        return word in self.gaps or not self.gaps.isdisjoint(gapped(word))

    def within(self, word: str, most: int = 1) -> str | None:
        """The nearest term at ``most`` edits (change, gap, extra letter, swap of neighbours), ties to the first in order.

        The states of the word's Levenshtein automaton are the rows of the edit table; each edge of the trie is a step
        of it, and a branch ends where no state is left.
        """
        best: tuple[int, str] | None = None
        stack = [(self.root, list(range(len(word) + 1)), None, "")]
        while stack:
            node, row, above, letter = stack.pop()
            term = node.get("")
            if term is not None and len(term) >= FUZZY_LENGTH and row[-1] <= most and (best is None or (row[-1], term) < best):
                best = (row[-1], term)
            for c, child in node.items():
                if not c:
                    continue
                following = [row[0] + 1]
                for i, w in enumerate(word):
                    d = min(following[i] + 1, row[i + 1] + 1, row[i] + (w != c))
                    if above is not None and i and w == letter and word[i - 1] == c:
                        d = min(d, above[i - 1] + 1)
                    following.append(d)
                if min(following) <= most or min(row) <= most - 1:
                    stack.append((child, following, row, c))
        return best[1] if best else None


def stems(word: str) -> list[str]:
    """The word's beginnings, marked by ``*``, which no clean word ends with."""
    return [word[:n] + "*" for n in STEMS if len(word) > n]


class Lexicon:
    """Terms and their weights, and a table of the words already met."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.trie = Trie(sorted(t for t in weights if not t.endswith("*")))
        self.met: dict[str, tuple[float, int] | int] = {}

    def look_up(self, raw: str) -> tuple[float, int] | int:
        """Weight and kind (0: itself, 1: one edit away, 2: its beginning) of the term that a word meets; 0 if none."""
        word = clean(raw)
        found: tuple[float, int] | int = 0
        if word in self.weights:
            found = (self.weights[word], 0)
        elif len(word) >= FUZZY_LENGTH - 1 and self.trie.possible(word) and (term := self.trie.within(word)):
            found = (self.weights[term], 1)
        elif begun := [self.weights[s] for s in stems(word) if s in self.weights]:
            found = (max(begun), 2)
        if len(self.met) < TABLE_ENTRIES:
            self.met[raw] = found
        return found

    def features(self, text: str) -> list[float]:
        """Sums over the text's meetings with terms, see ``N_FEATURES``."""
        split = text.split()
        found = list(map(self.met.get, split))
        if None in found:
            found = [self.look_up(w) if f is None else f for w, f in zip(split, found, strict=True)]
        if not any(found):
            return [0.0] * N_FEATURES
        abuse, quoted, terms = [0.0, 0.0, 0.0], 0.0, [set(), set(), set()]
        quotes = any(c in text for c in _QUOTES)
        for i, f in enumerate(found):
            if f:
                if quotes and self._is_quoted(split, i):
                    quoted += f[0]
                else:
                    abuse[f[1]] += f[0]
                    terms[f[1]].add(split[i])
        sums = [np.log1p(x) for x in (abuse[0], abuse[1], quoted, abuse[2])]
        return sums + [100 * x / (len(split) + 10) for x in abuse] + [np.log1p(len(t)) for t in (terms[0], terms[2])]

    @staticmethod
    def _is_quoted(split: list[str], i: int) -> bool:
        before, after = split[max(0, i - CONTEXT) : i], split[i + 1 : i + 1 + CONTEXT]
        left = sum(c in _QUOTES for w in before for c in w)
        word = split[i]
        opens = word[:1] in _QUOTES or left % 2 == 1
        closes = any(c in _QUOTES for c in word[1:]) or any(c in _QUOTES for w in after for c in w)
        return opens and closes or any(clean(w) in _REPORTING for w in before[-2:]) and opens


N_FEATURES = 9


class Model:
    """Lexicon and the weights of the sums."""

    def __init__(self, lexicon: dict[str, float]):
        self.terms = lexicon
        self.w = np.zeros(N_FEATURES)
        self.b = -3.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, toxic_weight: float) -> Model:
        """Newton steps of a ridge-penalised logistic regression."""
        z = np.concatenate([x, np.ones((len(x), 1))], 1)
        weight = np.where(y > 0, toxic_weight, 1.0)
        theta = np.zeros(N_FEATURES + 1)
        theta[-1] = self.b
        ridge = np.diag([0.5] * N_FEATURES + [0.01])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            gradient = z.T @ (weight * (p - y)) + ridge @ theta
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, gradient)
            theta -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        self.w, self.b = theta[:-1], float(theta[-1])
        return self


def held_out():
    return crc_of_id() % 4 == 2


def _drawn(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """A bounded sample of the labelled texts that are not held out: doc_id, text, toxic. Written once."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return None
    rate = F.when(F.col("toxic") == 1, min(1.0, TOXIC_TEXTS / counts[1])).otherwise(min(1.0, OTHER_TEXTS / counts.get(0, 1)))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic")), F.lit(1 << 20)) < rate * (1 << 20))
    drawn = drawn.limit(2 * (TOXIC_TEXTS + OTHER_TEXTS))
    return staged(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id"), "toxic_sample")


def train_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon and weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) that are not held out.

    The lexicon is learnt from the whole sample; the weights of the sums are learnt from one half of it, with the
    lexicon of the other half, so that terms which fit their own texts by chance are not trusted too much.
    """
    sample = _drawn(docs, labels)
    if sample is None:
        return Model({})
    sample = sample.withColumn("half", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)).cast("int"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = [], []
            for k, text in enumerate(batch.column(0).to_pylist()):
                found = {clean(w) for w in (text or "").split()}
                found |= {s for w in found for s in stems(w)}
                out += found
                rows += [k] * len(found)
            rows = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1).take(rows), batch.column(2).take(rows)], names=["word", "toxic", "half"])

    totals = [[0, 0], [0, 0]]
    for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect():
        totals[r["toxic"]][r["half"]] = r["n"]
    in_half = F.when(F.col("half") == 0, 1).otherwise(0)
    counted = staged(
        sample.select("text", "toxic", "half").mapInArrow(distinct, "word string, toxic int, half int").where(F.length("word") >= 3).groupBy("word").agg(
            F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other"),
            F.sum(F.col("toxic") * in_half).alias("toxic_half"), F.sum((1 - F.col("toxic")) * in_half).alias("other_half"),
        ),
        "toxic_words",
    )

    def strongest(toxic: str, other: str, n_toxic: int, n_other: int) -> dict[str, float]:
        ratio = ((F.col(toxic) + 0.1) / (n_toxic + 1)) / ((F.col(other) + 0.5) / (n_other + 1))
        least = max(2, min(8, n_toxic // 40))
        found = counted.where((F.col(toxic) >= least) & (ratio >= F.when(F.col("word").endswith("*"), STEM_RATIO).otherwise(RATIO))).select("word", F.col(toxic).alias("n"), F.log(ratio).alias("weight"))
        return {r["word"]: float(r["weight"]) for r in found.orderBy(F.desc(F.col("n") * F.col("weight")), "word").limit(TERMS).collect()}

    halved = strongest("toxic_half", "other_half", totals[1][0], totals[0][0])
    model = Model(strongest("toxic", "other", sum(totals[1]), sum(totals[0])))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(halved)
        for batch in batches:
            x = [lexicon.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    other = sample.where(F.col("half") == 1).select("text", "toxic").mapInArrow(sums, "x array<double>, toxic int")
    rows = sorted((list(r["x"]), r["toxic"]) for r in other.collect())
    x, y = np.array([r[0] for r in rows]).reshape(len(rows), N_FEATURES), np.array([r[1] for r in rows], float)
    return model.train(x, y, min(10.0, max(1.0, totals[0][1] / max(1, totals[1][1]) / 3)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    Rows whose crc32 of the id modulo 4 is 2 are held out: their labels are not learnt from. A null or empty text
    meets no term and gets the least score. Without a toxic label nothing is learnt and every score is that of a text
    without terms. Repeated rows stay; other columns are not read.
    """
    model = train_toxicity(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for whole in batches:
            for batch in slices(whole, 2):
                x = np.array([lexicon.features(t or "") for t in batch.column(2).to_pylist()]).reshape(batch.num_rows, N_FEATURES)
                score = np.clip(model.score(x), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(score), pa.array((score >= 0.3).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
