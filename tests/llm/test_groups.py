import re
from collections import Counter

import numpy as np
import pytest

from gridlore.llm import jaccard_partenum as J
from gridlore.llm.jaccard_partenum import jaccard_components, keep_first
from gridlore.llm.suffix_dedup import repeated_passages, without_repeats

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


def edited(text, *places):
    w = text.split(" ")
    for p in places:
        w[p % len(w)] = f"new{p}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_copies(odd_texts):
    texts = list(odd_texts)
    for k in range(12):
        base = prose(100 + k, 20 + 25 * k)
        texts += [base, base.upper(), base + "\n"] + [edited(base, *range(j, len(base.split()), 97 - 5 * j)) for j in range(6)]
    line = prose(7, 60)
    texts += [prose(200 + k, 30 + k) + " " + line + " " + prose(300 + k, 20) for k in range(40)]  # a common passage
    base = prose(8, 80)
    texts += [edited(base, 3 * k) for k in range(26)] + [edited(base, 3 * k, 3 * k + 40) for k in range(20)]  # a chain-like cluster
    texts += ["a b c d", "A b c d", "a b c d e", "a b c d e f", "x " * 50, "x " * 60]
    return texts


def test_components_equal_brute_force(make_docs, near_copies):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(make_docs(near_copies)).collect()}
    assert got == brute_components(near_copies)


def test_components_without_common_shingles_and_in_small_blocks(make_docs, near_copies, monkeypatch):
    """Neither the list of common shingles nor the size of blocks changes the result."""
    monkeypatch.setattr(J, "MOST_COMMON", 1)
    monkeypatch.setattr(J, "BLOCK", 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(make_docs(near_copies)).collect()}
    assert got == brute_components(near_copies)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 17, 60, 130, 300])
def test_similar_sets_share_a_signature(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        gone, come = rng.integers(0, n // 4 + 1), rng.integers(0, n // 3 + 1)
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, come, dtype=np.uint64)]))
        if len(b) and J.LINKS.similar(len(a), len(b), len(np.intersect1d(a, b))):
            for common in (np.zeros(0, np.uint64), np.sort(a[: n // 2]), a):
                assert set(J.signatures(a, common)) & set(J.signatures(b, common))
            count = lambda s: np.frombuffer(J.sketch(s), np.uint8)
            assert J.LINKS.within_reach(len(a), count(a), len(b), count(b))


def test_components_of_no_documents(make_docs):
    assert jaccard_components(make_docs([])).count() == 0
    assert keep_first(make_docs([])).count() == 0


def test_one_of_each_group_stays(make_docs, near_copies):
    docs = make_docs(near_copies)
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    want = {k for k, (_, c) in brute_components(near_copies).items() if k == c}
    assert {r["doc_id"] for r in kept.collect()} == want


def brute_repeats(texts, n=50):
    first, found = {}, {}
    for doc, text in enumerate(texts):
        w = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text or "")]
        for s in range(len(w) - n + 1):
            key = tuple(x[2] for x in w[s : s + n])
            d, p = first.setdefault(key, (doc, s))
            if d != doc or s >= p + n:
                spans = found.setdefault(doc, [])
                if spans and s <= spans[-1][2] + n:
                    spans[-1][1:] = w[s + n - 1][1], s
                else:
                    spans.append([w[s][0], w[s + n - 1][1], s])
    return {d: sorted((a, b) for a, b, _ in spans) for d, spans in found.items()}


@pytest.fixture(scope="module")
def repeating(odd_texts):
    passage, other = prose(20, 70), prose(21, 55)
    texts = [t for t in odd_texts if t is None or len(t) < 1000]
    texts += [prose(30 + k, 20 + 9 * k) + (" é\n " if k % 2 else " ") + passage + " " + prose(60 + k, 40) for k in range(8)]
    texts += [other + " " + prose(90, 30) + " " + other, passage + " " + other, prose(91, 49), prose(91, 49), "y " * 180]
    return texts + [edited(passage, 5) + " end", passage, "start " + passage]


def test_repeats_equal_brute_force(make_docs, repeating):
    got = {}
    for r in repeated_passages(make_docs(repeating)).collect():
        assert (r["source_doc_id"], r["source_start"]) < (r["doc_id"], r["start"])
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    want = brute_repeats(repeating)
    # A copy of all words is one span over the whole text.
    whole = {d for d, s in got.items() if s == [(0, len(repeating[d]))]}
    assert {d: sorted(s) for d, s in got.items() if d not in whole} == {d: s for d, s in want.items() if d not in whole}
    assert whole <= set(want)


def test_repeats_are_cut_out(make_docs, repeating):
    docs = make_docs(repeating)
    kept = without_repeats(docs)
    assert kept.columns == docs.columns
    left = {r["doc_id"]: r for r in kept.collect()}
    assert not brute_repeats([left[k]["text"] if k in left else None for k in range(len(repeating))])
    spans = brute_repeats(repeating)
    for k, text in enumerate(repeating):
        if k not in spans:
            assert left[k]["text"] == text
        elif k in left:
            assert left[k]["n_chars"] == len(left[k]["text"])


def test_repeats_of_no_documents(make_docs):
    assert repeated_passages(make_docs([])).count() == 0
    assert without_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("long_run", [4096, 3])
def test_runs_across_batches(monkeypatch, long_run):
    """Signatures and suffixes that go on in the next batch are told apart as in one batch, long ones too."""
    import pyarrow as pa

    from gridlore.llm import suffix_dedup as S

    monkeypatch.setattr(J, "LONG_RUN", long_run)
    rows = sorted((int(k), int(n)) for k, n in np.random.default_rng(4).integers(0, 40, (700, 2)))
    one = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["head", "node"])]
    many = [one[0].slice(k, 7) for k in range(0, 700, 7)]
    by_key = {}
    for k, n in rows:
        by_key.setdefault(k, set()).add(n)
    passed = lambda f, bs: [r for b in f(iter(bs)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    for batches in (one, many):
        got = set(passed(J._groups, batches))
        assert got == {(min(s), n) for s in by_key.values() if len(s) > 1 for n in s if n != min(s)}
        alike = Counter(passed(S._like_neighbours, batches))
        assert alike == Counter((n, k) for k, s in by_key.items() if len(s) > 1 for n in s)


def thue_morse(n, a, b):
    """Sequences over two parts of which sums of powers modulo 2**64 are alike, whatever the base."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return [b if x else a for x in bits], [a if x else b for x in bits]


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_and_texts_that_sums_modulo_two_to_the_64_confuse(make_docs, n):
    """Nothing is taken for a copy but what is one."""
    x, y = ("".join(w) for w in thue_morse(n, "a", "b"))
    p, q = (" ".join(w) for w in thue_morse(n, "ta", "ri"))
    texts = [f"{x} one two three four", f"{y} one two three four", f"{p} {prose(1, 3)}", f"{q} {prose(1, 3)}"]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(make_docs(texts[:2])).collect()}
    assert got == {0: 0, 1: 1}
    spans = {}
    for r in repeated_passages(make_docs(texts)).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert {d: sorted(s) for d, s in spans.items()} == brute_repeats(texts)


def test_columns_of_any_name_and_repeated_rows(spark):
    """Columns that are named as the operators' own stay; rows that repeat an id stand or fall together."""
    text, other = prose(1, 90), prose(2, 90)
    rows = [(0, text, 1, 2, 3, 4), (1, text, 1, 2, 3, 4), (1, text, 1, 2, 3, 4), (2, other, 1, 2, 3, 4), (2, other, 1, 2, 3, 4), (None, other, 1, 2, 3, 4), (3, prose(3, 60) + " " + other, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, id int, other int, head int")
    kept, cut = keep_first(docs), without_repeats(docs)
    assert kept.columns == cut.columns == docs.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, 0, 2, 2, 3]
    left = {(r["doc_id"], r["text"]) for r in cut.collect()}
    assert left == {(0, text), (2, other), (None, other), (3, prose(3, 60) + " ")}


def test_long_runs_are_split(make_docs, monkeypatch):
    """The first suffix of a run is sent to several places; the result stays."""
    from gridlore.llm import suffix_dedup as S

    passage = prose(20, 70)
    texts = [prose(100 + k, 8 + k % 30) + " " + passage + " " + prose(200 + k // 3, 30) for k in range(60)]
    monkeypatch.setattr(S, "BLOCK", 7)
    got = {}
    for r in repeated_passages(make_docs(texts)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert {d: sorted(s) for d, s in got.items()} == brute_repeats(texts)


def test_texts_that_share_an_id_are_cut_each_by_itself(make_docs):
    """Nothing is cut from a text but what is repeated of it."""
    passage, unique = prose(20, 60), prose(41, 200)
    copy = prose(40, 30) + " " + passage
    docs = make_docs([(1, prose(30, 20) + " " + passage), (5, copy), (5, unique), (5, copy), (6, unique), (7, copy + " " + prose(42, 9))])
    left = sorted((r["doc_id"], r["text"]) for r in without_repeats(docs).collect())
    kept = prose(40, 30) + " "
    assert left == sorted([(1, prose(30, 20) + " " + passage), (5, kept), (5, unique), (5, kept), (7, " " + prose(42, 9))])
    spans = {(r["doc_id"], r["start"], r["end"]) for r in repeated_passages(docs).collect()}
    assert spans == {(5, len(kept), len(copy)), (6, 0, len(unique)), (7, 0, len(copy))}


def test_suffixes_of_a_batch_are_extended_at_once(monkeypatch):
    """The work in Python grows with batches, not with suffixes; how they are dealt to batches changes nothing."""
    import pyarrow as pa

    from gridlore.llm import suffix_dedup as S

    passage, rows = prose(20, 70).split(), []
    for doc in range(300):
        text = " ".join(prose(100 + doc % 90, 8 + doc % 30).split() + passage[: 70 - doc % 17] + prose(200 + doc // 3, 30).split() + passage * (doc % 2))
        _, _, hashes, _ = S.words(*S.utf8(pa.array([text])), False)
        minimiser, heads = S._kept(hashes)
        wanted = [{"head": h, "block": 0, "blocks": 1, "leads": False} for h in np.unique(heads[minimiser]).view(np.int64).tolist()]
        table = pa.table({"doc_id": [doc], "text": [text], "same": [S._short(S._digest(hashes))], "heads": [wanted]})
        rows += [r for b in S._contexts(iter(table.to_batches())) for r in b.to_pylist()]
    rows.sort(key=lambda r: [r[k] for k in ("head", "block", "doc_id", "same", "place")])
    kinds = pa.schema([("head", pa.int64()), ("block", pa.int32()), *((k, pa.int64()) for k in ("doc_id", "same", "place")), ("before", pa.int32()), *((k, pa.binary()) for k in ("words", "starts", "ends"))])
    whole = pa.RecordBatch.from_pylist(rows, kinds)
    calls = Counter()

    def counted(h, mix=S.mix):
        calls["mix"] += 1
        return mix(h)

    monkeypatch.setattr(S, "mix", counted)
    extended = lambda size: Counter(tuple(r.values()) for b in S._extended(iter([whole.slice(k, size) for k in range(0, len(rows), size)])) for r in b.to_pylist())
    want = extended(len(rows))
    assert len(rows) > 1000 and calls["mix"] <= 20
    assert any(r[6] is not None for r in want) and any(r[6] is None for r in want)
    assert extended(1) == extended(7) == want
