"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over them, each filter's largest answer in a window is kept, and a
softmax layer names the language. The network is trained in numpy on windows of labelled texts and applied to all
fixed-length windows of every whole text, whose probabilities are averaged by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import crc_of_id, slices, utf8

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: About so many labelled texts of each language are learnt from (fewer, if all languages would have more than
#: ``MOST_TEXTS`` of them together, but one at least), and so many windows of each text.
TEXTS_PER_LANGUAGE = 1500
MOST_TEXTS = 120_000
WINDOWS_PER_TEXT = 4
#: Languages up to which their rates are broadcast; above, they are joined.
BROADCAST_LANGUAGES = 100_000
#: From so many expected texts of a language on, none is left out by chance (a chance of e^-40).
SURE = 40
EPOCHS = 8
#: Share of the windows that are cut to a random length when they are learnt from, as short texts are.
SHORTENED = 0.25
#: Bytes whose windows the filters run over at once.
BLOCK_BYTES = 1 << 15

UNKNOWN = "und"
#: ``keep_known`` lets a text go whose best language has less than this probability, ...
LEAST_SCORE = 0.5
#: ... or whose own ``lang``, one of those learnt, has less than this one.
LEAST_OWN = 0.05


class ByteNetwork:
    """Parameters of the network, and the tables by which it is applied."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = [rng.normal(0, (EMBEDDING * w) ** -0.5, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.top = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.top_bias = np.zeros(len(languages), np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.top, self.top_bias]

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 11) -> ByteNetwork:
        """Adam on the cross entropy; each language weighs alike."""
        rng = np.random.default_rng(seed)
        counts = np.bincount(labels, minlength=len(self.languages))
        weight = (1 / np.maximum(counts, 1))[labels]
        weight = (weight / weight.mean()).astype(np.float32)
        parameters = self._parameters()
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        step, size = 0, 64
        epochs = max(EPOCHS, min(60, 60_000 // max(1, len(labels))))
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for low in range(0, len(order), size):
                rows = order[low : low + size]
                step += 1
                kept = np.where(rng.random(len(rows)) < SHORTENED, WINDOW ** rng.random(len(rows)) + 2, WINDOW)
                seen = np.where(np.arange(WINDOW) < kept[:, None], windows[rows], 0).astype(np.uint8)
                for p, g, m, v in zip(parameters, self._gradients(seen, labels[rows], weight[rows]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        return self

    def _gradients(self, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n = len(windows)
        x = self.embedding[windows]
        rows, columns = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        best, pooled = [], []
        for filters in self.filters:
            w = len(filters)
            out = sum(x[:, j : x.shape[1] - w + 1 + j] @ filters[j] for j in range(w))
            at = out.argmax(1)
            best.append(at)
            pooled.append(out[rows, at, columns])
        hidden = np.concatenate(pooled, 1) + self.bias
        active = np.maximum(hidden, 0)
        logits = active @ self.top + self.top_bias
        chance = np.exp(logits - logits.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        chance[np.arange(n), labels] -= 1
        back = chance * weight[:, None] / n
        back_hidden = (back @ self.top.T) * (hidden > 0)
        back_embedding = np.zeros_like(self.embedding)
        back_filters = []
        for k, filters in enumerate(self.filters):
            part = back_hidden[:, k * FILTERS : (k + 1) * FILTERS]
            out = np.empty_like(filters)
            for j in range(len(filters)):
                seen = windows[rows, best[k] + j]  # byte under tap j of each filter
                out[j] = np.einsum("bf,bfe->ef", part, self.embedding[seen])
                np.add.at(back_embedding, seen, part[:, :, None] * filters[j].T[None])
            back_filters.append(out)
        return [back_embedding, *back_filters, back_hidden.sum(0), active.T @ back, back.sum(0)]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the filters' answers to pairs of bytes, and for an odd width to the last byte."""
        found = []
        for filters in self.filters:
            taps = [self.embedding @ f for f in filters]
            pairs = [(taps[j][:, None] + taps[j + 1][None]).reshape(65536, FILTERS) for j in range(0, len(taps) - 1, 2)]
            found.append(pairs + [taps[-1]] * (len(taps) % 2))
        return found

    def probabilities(self, data: np.ndarray, at: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Languages' probabilities of each text (bytes ``data``, offsets ``at``), all its windows averaged by bytes."""
        texts, gap = len(at) - 1, 2 * max(WIDTHS)
        size = np.diff(at)
        padded = np.zeros(len(data) + gap * (texts + 1), np.uint8)
        padded[np.arange(len(data)) + np.repeat(gap * np.arange(texts), size)] = data
        begin = at[:-1] + gap * np.arange(texts)
        # Where a filter would reach into the next text.
        across = (begin[:, None] + size[:, None] + np.arange(gap - max(WIDTHS) + 1, gap)).ravel()
        count = np.maximum(1, -(-size // WINDOW))
        owner = np.repeat(np.arange(texts), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = begin[owner] + within * WINDOW
        stop = np.append(start[1:], len(padded) - gap)
        pooled = np.empty((len(owner), FILTERS * len(WIDTHS)), np.float32)
        low = 0
        while low < len(owner):
            high = max(low + 1, int(np.searchsorted(start, start[low] + BLOCK_BYTES)))
            here = slice(low, high)
            n = int(stop[high - 1] - start[low])
            single = padded[start[low] : start[low] + n + gap - 1].astype(np.int32)
            pair = single[:-1] * 256 + single[1:]
            for w, (width, parts) in enumerate(zip(WIDTHS, tables, strict=True)):
                m = min(n, len(single) - width + 1)
                out = np.zeros((n, FILTERS), np.float32)
                for k, table in enumerate(parts):
                    out[:m] += table.take((single if len(table) == 256 else pair)[2 * k : 2 * k + m], axis=0)
                out[across[np.searchsorted(across, start[low]) : np.searchsorted(across, start[low] + n)] - start[low]] = -np.inf
                pooled[here, w * FILTERS : (w + 1) * FILTERS] = np.maximum.reduceat(out, start[here] - start[low], axis=0)
            low = high
        active = np.maximum(pooled + self.bias, 0)
        logits = active @ self.top + self.top_bias
        chance = np.exp(logits - logits.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        weight = np.clip(size[owner] - within * WINDOW, 1, WINDOW)
        total = np.add.reduceat(chance * weight[:, None], np.cumsum(count) - count, axis=0)
        return total / total.sum(1, keepdims=True)


def _windows(text: bytes) -> list[bytes]:
    """Windows spread evenly over the text, the first and the last among them."""
    n = max(1, -(-len(text) // WINDOW))
    picks = sorted({round(k * (n - 1) / max(1, WINDOWS_PER_TEXT - 1)) for k in range(WINDOWS_PER_TEXT)})
    return [text[p * WINDOW : (p + 1) * WINDOW].ljust(WINDOW, b"\0") for p in picks]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train_network(docs: DataFrame) -> ByteNetwork | None:
    """A network learnt from ``docs`` (doc_id, text, lang), about ``TEXTS_PER_LANGUAGE`` texts of each language.

    Texts are chosen by a hash of the id; null languages, and texts without a letter, teach nothing. None if nothing
    is left to learn from.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    each = min(TEXTS_PER_LANGUAGE, max(1, MOST_TEXTS // len(counts)))
    rates = docs.sparkSession.createDataFrame([(name, min(1.0, each / n)) for name, n in counts.items()], "lang string, rate double")
    if len(counts) <= BROADCAST_LANGUAGES:
        rates = F.broadcast(rates)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 20))
    drawn = known.join(rates, "lang").where(draw < F.col("rate") * (1 << 20))
    drawn = drawn.select("text", "lang")
    if each < SURE:
        # With few of each, chance may leave a language out: its text of least draw is taken then.
        lettered = known.where(F.col("text").rlike(r"\p{L}")).withColumn("draw", draw)
        least = lettered.groupBy("lang").agg(F.min("draw").alias("least")).join(rates, "lang").where(F.col("least") >= F.col("rate") * (1 << 20)).select("lang", "least")
        drawn = drawn.unionByName(lettered.join(least, "lang").where(F.col("draw") == F.col("least")).select("text", "lang"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, names = [], []
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    found = _windows(text.encode("utf-8", "surrogatepass"))
                    windows += found
                    names += [name] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(names, pa.string())], names=["bytes", "lang"])

    sample = drawn.mapInArrow(cut, "bytes binary, lang string").toArrow().sort_by([("lang", "ascending"), ("bytes", "ascending")])
    if not sample.num_rows:
        return None
    labels = np.asarray(sample.column("lang").to_pylist(), object)
    languages = sorted(set(labels))  # those of which a text with a letter was drawn
    windows = np.frombuffer(b"".join(sample.column("bytes").to_pylist()), np.uint8).reshape(len(labels), WINDOW)
    return ByteNetwork(languages).train(windows, np.searchsorted(np.array(languages, object), labels))


def predicted(texts: pa.Array, network: ByteNetwork | None, tables: list, chance: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text; ``chance`` are all languages' probabilities, if known already."""
    data, at = utf8(texts)
    names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if network is not None and len(texts):
        chance = network.probabilities(data, at, tables) if chance is None else chance
        best = chance.argmax(1)
        names, scores = np.array(network.languages, object)[best], chance.max(1).astype(np.float64)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    seen = np.concatenate([[0], np.cumsum(ascii_letter[data])])
    for k in np.flatnonzero(seen[at[1:]] == seen[at[:-1]]):
        if not has_letter(texts[int(k)].as_py()):
            names[k], scores[k] = UNKNOWN, 0.0
    return list(names), np.clip(scores, 0.0, 1.0)


def held_out():
    return crc_of_id() % 5 == 0


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang).

    Rows whose crc32 of the id modulo 5 is 0 (and those with a null id or language) are not learnt from. ``lang_pred``
    is ``und``, with score 0, for a null text or one without a letter, or if nothing could be learnt. Repeated rows
    stay; other columns are not read.
    """
    network = train_network(docs.where(~held_out()))
    tables = network.tables() if network else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 1 << 20):
                names, scores = predicted(batch.column(2), network, tables)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and others) whose language the network is sure of, in its own columns.

    Those go whose text is null or has no letter, whose best language has a probability under ``LEAST_SCORE``, or
    whose own ``lang`` is one of those learnt and has one under ``LEAST_OWN``. A null or unknown ``lang`` contradicts
    nothing. Where nothing could be learnt, the rows whose text has a letter stay. Repeated rows stand or fall together.
    """
    network = train_network(docs.where(~held_out()))
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")
    tables = network.tables() if network else []
    place = {name: k for k, name in enumerate(network.languages)} if network else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_at):
                texts = batch.column(text_at)
                if network is None:
                    yield batch.filter(pa.array([has_letter(t) for t in texts.to_pylist()], pa.bool_()))
                    continue
                chance = network.probabilities(*utf8(texts), tables)
                names, scores = predicted(texts, network, tables, chance)
                own = [place.get(name) for name in batch.column(lang_at).cast(pa.string()).to_pylist()]
                keep = [n != UNKNOWN and s >= LEAST_SCORE and (k is None or c[k] >= LEAST_OWN) for n, s, k, c in zip(names, scores, own, chance, strict=True)]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
