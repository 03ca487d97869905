"""Quality scores by positive-unlabelled learning.

A small network is trained on statistics of texts to minimise the non-negative unbiased risk (Kiryo et al. 2017):
trusted positives stand for the good class, unlabelled web text for the mixture, and the share of good texts in the
mixture is estimated first (best-bin estimator). Negative labels are never used. The loss is bounded: with an unbounded
one and a share that is estimated too high, all texts would end up good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import crc_of_id, kept_rows, slices, utf8, words

#: About so many trusted positives, and so many unlabelled texts, are learnt from.
POSITIVES = 6000
UNLABELLED = 12000
HIDDEN = 24
STEPS = 1500
#: Weight decay: the first number, and the second over the number of unlabelled texts, so that few are not learnt by heart.
DECAY = (1e-4, 3.0)
#: Share of its allowance for chance by which the class prior is lowered.
CAUTION = 0.1

_KINDS = np.zeros(256, np.int8)  # 0: other printing ASCII
_KINDS[97:123] = 1
_KINDS[65:91] = 2
_KINDS[48:58] = 3
_KINDS[[32, 9, 11, 12, 13]] = 4
_KINDS[10] = 5
_KINDS[[44, 46]] = 6
_KINDS[[33, 39, 40, 41, 45, 58, 59, 63]] = 7
_KINDS[128:] = 8
N_KINDS = 9
N_FEATURES = 2 * N_KINDS + 14


def features(column: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` statistics for each text, of its whole length; all 0 for an empty one."""
    data, at = utf8(column)
    n = len(at) - 1
    out = np.zeros((n, N_FEATURES))
    start, end, hashes, word_at = words(data, at, True)
    length = (end - start).astype(np.float64)
    kinds = _KINDS[data]
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    closing = _KINDS[last] == 0
    for k in range(n):
        low, high = at[k], at[k + 1]
        if low == high:
            continue
        share = np.bincount(kinds[low:high], minlength=N_KINDS) / (high - low)
        out[k, :N_KINDS], out[k, N_KINDS : 2 * N_KINDS] = share, np.sqrt(share)
        a, b = word_at[k], word_at[k + 1]
        m = b - a
        row = out[k, 2 * N_KINDS :]
        row[0] = np.log1p(high - low)
        row[1] = np.log1p(m)
        if not m:
            continue
        own, size = hashes[a:b], length[a:b]
        ordered = np.sort(own)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        runs = np.diff(edge)
        row[2] = len(runs) / m
        row[3] = runs.max() / m
        row[4] = len(runs) / np.sqrt(m)
        row[5] = np.mean(own[1:] == own[:-1]) if m > 1 else 0.0
        row[6], row[7], row[8] = size.mean() / 10, size.std() / 10, np.log(size.max())
        row[9] = np.mean(size <= 3)
        row[10] = np.mean(size > 12)
        row[11] = closing[a:b].mean()
        row[12] = np.mean((size == 1) & closing[a:b])
        row[13] = np.log1p((runs * runs).sum() / m)
    return out


class PUNetwork:
    """One hidden layer over standardised statistics; ``score`` is the chance of the good class."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = rng.normal(0, len(mean) ** -0.5, (len(mean), HIDDEN))
        self.b = np.zeros(HIDDEN)
        self.v = rng.normal(0, HIDDEN**-0.5, HIDDEN)
        self.c = np.zeros(1)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(z @ self.w + self.b)
        return hidden, hidden @ self.v + self.c

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._forward(self.scaled(x))[1]))

    def train(self, good: np.ndarray, mixed: np.ndarray, prior: float | None, seed: int = 5) -> PUNetwork:
        """Adam on the non-negative risk; without a prior, on telling trusted from unlabelled texts apart."""
        rng = np.random.default_rng(seed)
        good, mixed = self.scaled(good), self.scaled(mixed)
        decay = DECAY[0] + DECAY[1] / len(mixed)
        parameters = [self.w, self.b, self.v, self.c]
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        for step in range(1, STEPS + 1):
            p = good[rng.integers(0, len(good), 256)]
            u = mixed[rng.integers(0, len(mixed), 512)]
            z = np.concatenate([p, u])
            hidden, answer = self._forward(z)
            chance = 1 / (1 + np.exp(-answer))
            back = np.empty(len(z))
            chance_p, chance_u = chance[: len(p)], chance[len(p) :]
            if prior is None:
                back[: len(p)], back[len(p) :] = (chance_p - 1) / len(p), chance_u / len(u)
            else:  # sigmoid loss, which is bounded: 1 - chance for the good class, chance for the other
                slope = chance * (1 - chance)
                sign = 1 if chance_u.mean() >= prior * chance_p.mean() else -1  # below nought, which only overfitting does: step back
                back[: len(p)] = -prior * slope[: len(p)] / len(p) * (2 if sign > 0 else -1)
                back[len(p) :] = sign * slope[len(p) :] / len(u)
            inner = (back[:, None] * self.v) * (1 - hidden * hidden)
            gradients = [z.T @ inner + decay * self.w, inner.sum(0), hidden.T @ back + decay * self.v, back.sum(keepdims=True)]
            rate = 0.01 * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for q, g, m, v in zip(parameters, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def class_prior(trusted: np.ndarray, mixed: np.ndarray) -> float:
    """Share of the good class in ``mixed``, from scores that tell trusted from unlabelled texts apart.

    The least ratio of the two sets' shares above a threshold, with an allowance for chance, over thresholds that
    leave at least a twentieth of the trusted texts above; less a share of that allowance.
    """
    cuts = np.quantile(trusted, np.linspace(0.0, 0.95, 96))
    above_p = 1 - np.searchsorted(np.sort(trusted), cuts) / len(trusted)
    above_u = 1 - np.searchsorted(np.sort(mixed), cuts) / len(mixed)
    slack = np.sqrt(np.log(400) / (2 * len(mixed))) + np.sqrt(np.log(400) / (2 * len(trusted)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best] - CAUTION * slack, 0.05, 0.98))


def _sampled(docs: DataFrame, rate: float, salt: str) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(salt)), F.lit(1 << 20)) < rate * (1 << 20))


def _matrix(docs: DataFrame) -> np.ndarray:
    """Statistics of a bounded number of texts, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                yield pa.RecordBatch.from_arrays([pa.array(list(features(batch.column(0))), pa.list_(pa.float64()))], names=["x"])

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "x array<double>").collect()
    return np.array(sorted(list(r["x"]) for r in rows)).reshape(len(rows), N_FEATURES)


def learnt(trusted: np.ndarray, mixed: np.ndarray) -> PUNetwork:
    """A network learnt from statistics of trusted good and of unlabelled texts, whose class prior is estimated first."""
    mean, spread = mixed.mean(0), mixed.std(0) + 1e-3
    half = np.arange(len(trusted)) % 2 == 0
    judge = PUNetwork(mean, spread).train(trusted[half], mixed[::2], None)
    prior = class_prior(judge.score(trusted[~half]), judge.score(mixed[1::2]))
    return PUNetwork(mean, spread).train(trusted, mixed, prior)


def held_out():
    return crc_of_id() % 3 == 1


def train_quality(docs: DataFrame, labels: DataFrame) -> PUNetwork | None:
    """Learn from ``docs`` (doc_id, text) and the rows of ``labels`` (doc_id, quality) that are not held out.

    About ``POSITIVES`` texts labelled 1 and ``UNLABELLED`` texts, drawn by a hash of the id. None without either.
    """
    open_docs = docs.where(~held_out())
    good = labels.where((F.col("quality") == 1) & ~held_out()).select("doc_id").distinct()
    good = _sampled(good, min(1.0, POSITIVES / max(1, good.count())), "trusted").limit(2 * POSITIVES)
    trusted = _matrix(open_docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left_semi"))
    mixed = _matrix(_sampled(open_docs, min(1.0, UNLABELLED / max(1, open_docs.count())), "unlabelled"))
    return learnt(trusted, mixed) if len(trusted) > 1 and len(mixed) > 1 else None


def scores(column: pa.Array, network: PUNetwork | None) -> np.ndarray:
    if network is None:
        return np.full(len(column), 0.5)
    return np.clip(network.score(features(column)), 0.0, 1.0)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    Rows whose crc32 of the id modulo 3 is 1 are held out: neither their labels nor their texts are learnt from. An
    empty or null text is scored as any other, by its statistics; every score is 0.5 if nothing could be learnt.
    Repeated rows stay; other columns are not read.
    """
    network = train_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                score = scores(batch.column(2), network)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) whose score is 0.5 or more, in its own columns."""
    network = train_quality(docs, labels)
    return kept_rows(docs, lambda texts: scores(texts, network) >= 0.5)
