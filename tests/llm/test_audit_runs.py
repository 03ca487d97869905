"""The filter audit, periodic runs and min-max near duplicates against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from gridlore.llm import jaccard_partenum as J
from gridlore.llm import minmax_dedup as M
from gridlore.llm import periodic_runs as R
from gridlore.llm import queries as Q
from gridlore.llm.filter_audit import audit_filters

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


# ------------------------------------------------------------------- audit


def fails(text):
    w = WORD.findall(text)
    checks = {
        "A": len(w) < 50,
        "B": 100 * len(set(w)) < 65 * len(w),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }
    return {f for f, bad in checks.items() if bad}


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); every order is applied to every row."""
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in range(2))
    docs = []
    for doc, text, source in rows:
        bad = fails(text or "")
        if doc is not None and doc > least[text or ""]:
            bad = bad | {"E"}
        docs.append((source or "", doc, bad))
    out, shares = {}, {}
    for part in {p for p, *_ in docs}:
        own = [(doc, bad) for p, doc, bad in docs if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = [False] * len(own)
            for step, f in enumerate(order, 1):
                hit = [not g and f in bad for g, (_, bad) in zip(gone, own, strict=True)]
                redundant = sum(g and f in bad for g, (_, bad) in zip(gone, own, strict=True))
                gone = [g or h for g, h in zip(gone, hit, strict=True)]
                lost = [doc for h, (doc, _) in zip(hit, own, strict=True) if h]
                unique = sum(bad == {f} for _, bad in own)
                out[part, order, step] = [gone.count(False), sum(hit), redundant, unique, sum(d in good for d in lost), sum(d in toxic for d in lost)]
                shares[part, f] = shares.get((part, f), 0) + sum(hit)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, source string, mask int, n int, digest string")
    got = audit_filters(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", *COUNTS]
    found = got.collect()
    assert len(found) == len({r["part"] for r in found}) * 600
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in found}


def test_audit_equals_every_order_applied(spark):
    rng = random.Random(3)
    kinds = [lambda k: prose(k, 60), lambda k: prose(k, 20), lambda k: prose(k % 3, 5) * 20, lambda k: prose(k, 70).upper(), lambda k: prose(k, 55) + " #$", lambda k: "same text"]
    rows = [(k, rng.choice(kinds)(k), rng.choice(["a", "b", None, ""])) for k in range(120)]
    rows += [(200, None, "a"), (201, "", "a"), (202, None, None), (None, "same text", "a"), (None, None, "b"), (3, "same text", "a"), (3, "same text", "a"), (3, "same text", "b")]
    rows += [(205, "😀 É\x0b$" + "W " * 60, "c"), (206, prose(1, 30_000), "c"), (207, "\x85 ", "c")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 120, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_one_text_many_times(spark):
    rows = [(k, "x y", f"s{k % 2}") for k in range(300)]
    assert audited(spark, rows, []) == brute_audit(rows, [])


def test_audit_of_no_documents(spark):
    assert audited(spark, [], []) == {}


def test_audit_with_other_filters(spark):
    docs = spark.createDataFrame([(0, "x", "s"), (1, "x", "s"), (2, "q", "s")], "doc_id long, text string, source string")
    got = audit_filters(docs, spark.createDataFrame([], LABELS), {"q": lambda text, words: text == "q"}, "z").collect()
    assert {(r["filter_order"], r["step"], r["removed"], r["shapley"]) for r in got} == {("qz", 1, 1, 2), ("qz", 2, 1, 2), ("zq", 1, 1, 2), ("zq", 2, 1, 2)}
    with pytest.raises(ValueError):
        audit_filters(docs, docs, {"E": lambda text, words: text == "q"})


def test_audit_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    run = con.execute(Q.oracle_sql()["op11_filter_audit"])
    names = [x[0] for x in run.description]
    got = Q.op11_filter_audit(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(run.fetchall())


# -------------------------------------------------------------------- runs


def brute_runs(w, least=12):
    """(start, length, period) of every maximal stretch with its smallest period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q - s), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for case in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w, size = [], rng.choice([0, 5, 20, 60, 150, 300])
            while len(w) < size:
                base = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, rng.choice([3, 8, 30])))]
                w += (base * rng.randint(1, 8))[: rng.randint(1, 60)]
            texts.append(w)
        least = rng.choice([12, 12, 2, 3, 7, 30])
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        columns = R.runs_of(np.array([x for w in texts for x in w], np.uint64), at, least)
        got = [[] for _ in texts]
        for k, *run in zip(*(c.tolist() for c in columns), strict=True):
            got[k].append(tuple(run))
        assert got == [sorted(brute_runs(w, least), key=lambda r: (r[0], r[2])) for w in texts], case


def test_phase_breaks_make_many_runs():
    """Two stretches of one period out of phase: a run for each odd distance, none of which a progression's ends tell."""
    w = [0, 1] * 20 + [0] + [0, 1] * 20
    got = [x.tolist() for x in R.runs_of(np.array(w, np.uint64), np.array([0, len(w)]))]
    assert sorted(zip(*got[1:], strict=True)) == brute_runs(w)
    assert len(brute_runs(w)) > 10


def planted(doc, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_row(doc, text):
    w = planted(doc, text)
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_query_of_runs(spark, tmp_path, odd_texts):
    texts = [t for t in odd_texts if t is None or len(t) < 5000] + [prose(k, 10 + k) for k in range(60)] + ["a b c " * 30, "x" + " y" * 40 + " z", "a\x0bb\x0c" * 9, "é 漢\x85 " * 20]
    rows = [(k, t, 1, 2) for k, t in enumerate(texts)] + [(5, "p q " * 9, 1, 2), (5, "p q " * 9, 1, 2), (None, "r s " * 9, 1, 2)]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 3
    spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed int").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted((brute_row(*r[:2]) for r in rows), key=order)


def test_runs_of_long_texts_and_of_none(spark, make_docs):
    line = prose(4, 7).split()
    text = " ".join(line * 20_000)
    found = R.periodic_runs(make_docs([text, prose(9, 50_000)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in found[0]["runs"]] == [(0, 140_000, 7)] and found[0]["collapsed"] == " ".join(line)
    assert found[1]["n_words"] == 50_000 and found[1]["collapsed"] == prose(9, 50_000)
    assert R.periodic_runs(make_docs([])).count() == 0


# ----------------------------------------------------------------- min-max


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k), find(k) == k) for k, s in enumerate(sets)}


def edited(text, *places):
    w = text.split(" ")
    for p in places:
        w[p % len(w)] = f"new{p}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_copies(odd_texts):
    texts = [t for t in odd_texts if t is None or len(t) < 5000]
    for k in range(12):
        base = prose(100 + k, 6 + 25 * k)
        texts += [base, base.upper(), base + "\n", base + " " + base] + [edited(base, *range(j, len(base.split()), 31 - 3 * j)) for j in range(6)]
    base = prose(8, 80)
    texts += [edited(base, *range(0, 3 * k, 3)) for k in range(26)]  # a chain: only neighbours are alike
    return texts + ["a b c d", "A b c d", "a b c d e", "a b c d e f", "x " * 50, "x " * 60]


def test_minmax_components_equal_brute_force(make_docs, near_copies):
    got = M.minmax_components(make_docs(near_copies))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute_components(near_copies)


def test_minmax_keeps_one_of_each(make_docs, near_copies):
    docs = make_docs(near_copies + [(None, near_copies[20]), (None, None)])
    kept = M.keep_originals(docs)
    assert kept.columns == docs.columns
    want = {k for k, (*_, first) in brute_components(near_copies).items() if first}
    assert {r["doc_id"] for r in kept.collect()} == want | {None}
    assert M.minmax_components(make_docs([])).count() == 0 and M.keep_originals(make_docs([])).count() == 0


def test_minima_and_maxima_estimate_alike():
    """Either agrees as often as the sets are similar; a band misses as often as is stated."""
    rng = np.random.default_rng(2)
    by, missed, means = M.multipliers(), 0, []
    for _ in range(300):
        a = rng.integers(0, 2**63, 45, dtype=np.uint64)
        b = np.concatenate([a[:40], rng.integers(0, 2**63, 5, dtype=np.uint64)])  # similarity 0.8
        means.append(M.estimate(a, b, by))
        x, y = M.bands([a, b], by)
        missed += not (x == y).any()
    assert abs(np.mean(means) - 0.8) < 0.01 and missed == 0


def test_sets_that_share_half_a_digest_are_told_apart(make_docs):
    """With the first salt, all sets have one node: the next one is taken."""
    real = J.node_of
    unlucky = lambda x, salt=0: (7, real(x)[1]) if salt == 0 else real(x, salt)
    docs = make_docs([prose(k, 30) for k in range(5)] + [prose(1, 30)])
    sets, salt = J.told_apart(lambda s: docs.sparkSession.createDataFrame([(k, 1, *map(int, unlucky(np.array([k % 5], np.uint64), s))) for k in range(6)], J.SETS))
    assert salt == 1 and sets.select("node").distinct().count() == 5
