import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from gridlore.llm.packing import Schedule, WordTable, pack_documents, special_tokens
from gridlore.llm.sentencepiece_table import encode_documents

from .conftest import prose


def test_sentencepiece_equals_the_library(spark, make_docs, odd_texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = odd_texts + [prose(k, 40).replace("os", "\n") for k in range(20)]
    got = {r["doc_id"]: r for r in encode_documents(make_docs(texts), P.path("piece_bpe_32k.model")).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        ids = sp.encode(text or "")
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded"] == sp.decode(ids)
        assert got[k]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_sentencepiece_of_no_documents(make_docs):
    assert encode_documents(make_docs([("x", "y")][:0]), P.path("piece_bpe_32k.model")).count() == 0


def check_packing(rows, ids_of, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        ids, at = ids_of[doc], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes = {}
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(sizes[s] == window for s in range(len(sizes) - 1)) and sizes[len(sizes) - 1] <= window


@pytest.mark.parametrize("targets", [None, {"s0": 0.7, "s1": 0.2, "s2": 0.1}])
def test_packing_places_every_id_once(make_docs, odd_texts, targets):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = odd_texts + [prose(k, 200) for k in range(60)] + ["<|endoftext|> it's  5\n \n\n x" * 3]
    rows = pack_documents(make_docs(texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 64, 1, targets).collect()
    check_packing(rows, {k: t.encode(x or "", add_special_tokens=False).ids + [1] for k, x in enumerate(texts)}, 64)


def test_special_tokens_in_texts_are_those_tokens():
    """The same ids as the tokenizer's own call, whose settings are left as they are."""
    from tokenizers import Tokenizer

    name = P.path("byte_bpe_50k.json")
    t, table = Tokenizer.from_file(name), WordTable(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 2, special=special_tokens(name))
    for text in ["x<|endoftext|>", "<|endoftext|><|endoftext|> a", "a <|endoftext|>\n b", "<|endoftext|", "", "a b", " <|endoftext|>  <|endoftext|> 's"]:
        assert np.frombuffer(table.encode(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [0, 1000])
def test_packing_mixes_small_sources(spark, hot):
    """More sources than queues, each in one run of rows: every window holds them in proportion, to within a document."""
    rows = [(k, "aa bb cc dd", f"s{k // 10:03}") for k in range(2000)] + [(2000 + k, "aa bb cc dd", "hot") for k in range(hot)]
    rows += [(4000 + k, "aa bb cc dd", f"lone{k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {r[0]: r[2] for r in rows}
    pieces = pack_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 1000).collect()
    ids = np.frombuffer(WordTable(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 2).encode("aa bb cc dd"), "<u2").tolist() + [1]
    check_packing(pieces, dict.fromkeys(source, ids), 1000)
    windows = {}
    for r in pieces:
        windows.setdefault(r["sequence_id"], {}).setdefault(source[r["doc_id"]], []).append(r["length"])
    tokens, n = pieces[0]["doc_tokens"], len(windows)
    for held in list(windows.values())[:-1]:
        assert max(sum(x) for s, x in held.items() if s != "hot") <= tokens * (10 / n + 2)
        assert abs(sum(sum(x) for s, x in held.items() if s.startswith("lone")) - 1000 * 200 / len(rows)) < 80


def test_packing_of_no_documents(make_docs):
    assert pack_documents(make_docs([]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("totals, weights", [([700, 200, 100], None), ([10_000, 3, 0, 500], None), ([5000, 5000, 5000], [0.6, 0.3, 0.1]), ([1, 0, 0], None), ([2048] * 40, None)])
def test_schedule_keeps_the_mixture(totals, weights):
    """Every token stands once, windows are full, and shares are kept to within two tokens while all queues last."""
    window, plan = 128, Schedule(totals, 128, weights)
    windows = {}
    for queue, total in enumerate(totals):
        at = 0
        for end in [*range(37, total, 37), total]:
            for k, place, low, high in plan.pieces(queue, at, end) if end > at else []:
                assert low == at
                at = high
                windows.setdefault(k, []).append((place, high - low, queue))
        assert at == total
    for k, pieces in windows.items():
        place = 0
        for offset, n, _ in sorted(pieces):
            assert offset == place
            place += n
        assert place == min(window, sum(totals) - k * window)
    if weights:
        lasting = int(min(t / w for t, w in zip(totals, weights, strict=True)) * sum(weights)) // window
        for k in range(lasting):
            for queue, w in enumerate(weights):
                assert abs(sum(n for _, n, q in windows[k] if q == queue) - window * w) < 2


@pytest.mark.parametrize("seed", range(60))
def test_schedules_of_any_window(seed):
    """Thin, empty and equal queues in windows of 16 to 4096: every token stands once, every window but the last is full."""
    rng = np.random.default_rng(seed)
    window = int(rng.choice([16, 17, 64, 128, 1000, 2048, 4096]))
    n = int(rng.integers(1, min(40, window // 2) + 1))
    totals = [int(x) for x in (10 ** rng.uniform(0, 5, n)).astype(int) * (rng.random(n) < 0.9)]
    weights = None if seed % 2 else [float(x) for x in 10 ** rng.uniform(-4, 0, n)]
    plan, windows = Schedule(totals, window, weights), {}
    for queue, total in enumerate(totals):
        at = 0
        for k, place, low, high in plan.pieces(queue, 0, total) if total else []:
            assert low == at < high
            at = high
            windows.setdefault(k, []).append((place, high - low))
        assert at == total
    for k, pieces in windows.items():
        place = 0
        for offset, m in sorted(pieces):
            assert offset == place
            place += m
        assert place == min(window, sum(totals) - k * window)


def test_more_queues_than_a_window_holds():
    with pytest.raises(ValueError):
        Schedule([5] * 9, 16)


def test_words_that_a_text_adds_are_encoded_in_one_call(monkeypatch):
    """One call for each text's new words, with the ids of the whole text, full table or not."""
    import public_tokenizers as P

    text = "Aa bb don't 's 12cc. ?! é漢字 \nx yy bb\x85b zz\tz q" + "".join(f" w{k}," for k in range(50))
    for entries in (600_000, 20):
        table = WordTable(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 2, entries=entries)
        table._ordinary("Aa\nx")
        want, calls, encode = table.whole(text), [], table.bpe.encode_ordinary
        monkeypatch.setattr(table.bpe, "encode_ordinary", lambda t: calls.append(t) or encode(t))  # noqa: B023
        assert table._ordinary(text.replace("漢字 ", "漢字")) == np.array(encode(text.replace("漢字 ", "漢字")), "<u2").tobytes()
        assert len(calls) == 1 and len(table.inner) <= entries // 2
        assert table._ordinary(text) == want
