import zlib

import numpy as np
import pytest

from gridlore.llm import fingerprints, language_cnn, quality_pu, toxicity_automata
from gridlore.llm.ann_srs import chi_square, nearest_vectors

from .conftest import prose


def brute_edits(texts):
    order = sorted(texts, reverse=True)
    for k, d in enumerate(order):
        t, following = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(t) // 3
        yield d, t, t[: len(t) - cut] + following[:cut], following


def test_fingerprints_of_texts_and_edits(make_docs, odd_texts):
    import hashlib

    texts = {3 * k + 5: t for k, t in enumerate(odd_texts + [prose(k, 30 + k) for k in range(40)])}
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(make_docs(list(texts.items()))).collect()}
    assert set(got) == set(texts)
    same = {}
    for d, text, edited, following in brute_edits(texts):
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(fingerprints.PrefixHashes(text))
        assert r["edited_fingerprint"] == fingerprints.fingerprint(fingerprints.PrefixHashes(edited))
        assert (r["near_edited"] == 1.0) == (text == edited) and 0 <= r["near_next"] <= 1
        if len(text) > 30 and text != following:
            assert r["near_edited"] > 0.6
            assert r["near_edited"] > r["near_next"]
        assert same.setdefault(r["fingerprint"], text) == text


def test_fingerprints_of_one_and_no_document(make_docs):
    rows = fingerprints.fingerprint_documents(make_docs([(4, "abcdef")])).collect()
    assert len(rows) == 1 and rows[0]["n_chars"] == 6
    assert fingerprints.fingerprint_documents(make_docs([])).count() == 0


@pytest.mark.parametrize("text", [prose(5, 900), "abcdefghij" * 300, prose(6, 20_000), prose(7, 60) * 15])
def test_equal_content_between_edits_counts(text):
    near = lambda a, b: fingerprints.likeness(*(fingerprints.fingerprint(fingerprints.PrefixHashes(x)) for x in (a, b)))
    n = len(text)
    changed = text[:10] + "#" + text[11 : n - 10] + "#" + text[n - 9 :]
    grown = text[:10] + "#+#" + text[10 : n - 10] + text[n - 9 :]
    assert 0.8 < near(text, changed) < 1 and 0.8 < near(text, grown) < 1
    assert near(text, grown) == near(grown, text)
    assert 0.6 < near(text, text[n // 2 :] + text[: n // 2]) < 1 or text[: n // 2] == text[n // 2 :]
    assert near(text, prose(99, n // 5)) < 0.05


def test_spans_and_common_extensions():
    a, b = prose(1, 50), "x" + prose(1, 30) + "!" + prose(2, 20)
    x, y = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
    n = next(k for k in range(len(a)) if a[k] != b[k + 1])
    assert x.common_extension(0, y, 1) == n
    assert x.span(3, 17) == fingerprints.PrefixHashes(a[3:17]).span(0, 14) != x.span(4, 18)


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = [], []
    for k in range(900):
        bad, toxic = k % 4 == 0, k % 5 == 0
        words = prose(k, 40 + k % 30).split(" ")
        if bad:
            words = [w + "$$$" for w in words] if k % 8 else words[:1] * 40
        if toxic:
            words[5:5] = ["vilewort", "trasheous"]
            words[20:20] = ["nastyterm" if k % 10 else "nastytrem"]
        docs.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, int(not bad), int(toxic)))
    docs += [(1000, None, None, None, None), (1001, "", None, None, 0), (1001, "", None, None, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def crc(k):
    return zlib.crc32(str(k).encode())


def test_quality_on_held_out_texts(labelled):
    docs, labels = labelled
    rows = quality_pu.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_negative_quality_labels_are_not_learnt(labelled):
    docs, labels = labelled
    a = {r["doc_id"]: r["score"] for r in quality_pu.score_documents(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality_pu.score_documents(docs, labels.where("quality = 1")).collect()}
    assert a == b


@pytest.mark.parametrize("n", [100, 240, 900, 5000])
def test_quality_learns_from_few_texts(n):
    """Bad texts go and good ones stay, however few are learnt from."""
    import pyarrow as pa

    texts = [" ".join(w + "$$$" for w in prose(k, 60 + k % 40).split(" ")) if k % 6 == 0 else prose(k, 60 + k % 40) for k in range(n)]
    x, good, learnt = quality_pu.features(pa.array(texts)), np.arange(n) % 6 != 0, np.array([crc(k) % 3 != 1 for k in range(n)])
    trusted, mixed = x[learnt & good & (np.arange(n) % 2 == 1)], x[learnt]
    network = quality_pu.learnt(trusted, mixed)
    assert np.mean((network.score(x) >= 0.5) == good) > 0.97


def test_quality_of_no_documents_and_no_labels(labelled):
    docs, labels = labelled
    assert quality_pu.score_documents(docs.where("doc_id < 0"), labels).count() == 0
    assert quality_pu.keep_good(docs.where("doc_id < 0"), labels).count() == 0
    assert {r["score"] for r in quality_pu.score_documents(docs, labels.where("doc_id < 0")).collect()} == {0.5}


def test_class_prior():
    rng = np.random.default_rng(0)
    good, mixed = rng.normal(3, 1, 4000), np.concatenate([rng.normal(3, 1, 6000), rng.normal(-3, 1, 4000)])
    assert abs(quality_pu.class_prior(good, mixed) - 0.6) < 0.06


def test_toxicity_on_held_out_texts(labelled):
    docs, labels = labelled
    rows = toxicity_automata.score_documents(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert [r["predicted"] for r in rows if r["doc_id"] >= 1000] == [0, 0, 0]


def edits(a, b):
    """Changes, gaps, extra letters and swaps of neighbours between two words."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_meets_all_words_one_edit_away():
    terms = ["vilewort", "trash", "nasty", "badness"]
    trie = toxicity_automata.Trie(terms)
    words = {w[:i] + c + w[j:] for w in terms for i in range(len(w) + 1) for j in (i, i + 1, i + 2) for c in "ax"}
    words |= {w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :] for w in terms for i in range(len(w))} | {"other", "", "a"}
    for w in words:
        near = min(edits(w, t) for t in terms) <= 1
        assert (trie.within(w) is not None) == near
        assert not near or trie.possible(w)


def test_quotation_counts_apart():
    lexicon = toxicity_automata.Lexicon({"vilewort": 3.0})
    abuse, quoted = lexicon.features("you are a vilewort indeed"), lexicon.features('they said "you vilewort" to him')
    assert abuse[0] > 0 and abuse[2] == 0 and quoted[0] == 0 and quoted[2] > 0


@pytest.fixture(scope="module")
def languages(spark):
    alphabets = {"aa": "abcdefg ", "bb": "pqrstuv ", "cc": "éèàçù f "}
    rng = np.random.default_rng(3)
    rows = []
    for k in range(360):
        name = sorted(alphabets)[k % 3]
        rows.append((k, "".join(rng.choice(list(alphabets[name]), int(rng.integers(30, 900)))), name if k % 11 else None))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, "abc", None), (903, "abc", None), (904, "é" * 50_000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_on_held_out_texts(languages):
    rows = language_cnn.identify_documents(languages).collect()
    assert len(rows) == languages.count()
    want = {k: ("aa", "bb", "cc")[k % 3] for k in range(360)}
    held = [r for r in rows if r["doc_id"] in want and r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.97
    other = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] >= 900}
    assert other == {900: "und", 901: "und", 902: "und", 903: "aa", 904: "cc"}
    kept = language_cnn.keep_known(languages)
    assert kept.columns == languages.columns and kept.count() == languages.count() - 3


def test_the_network_decides_which_documents_stay(languages):
    """Texts with letters go if the network contradicts their language; a null or unknown one contradicts nothing."""
    from pyspark.sql import functions as F

    wrong = F.when(F.col("doc_id").isin(30, 31, 32, 33), F.lit("cc")).when(F.col("doc_id") == 35, F.lit("zz")).otherwise(F.col("lang"))
    docs = languages.withColumn("lang", wrong).withColumn("score", F.lit(1))
    kept = language_cnn.keep_known(docs)
    assert kept.columns == docs.columns
    gone = {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in kept.collect()}
    assert gone - {900, 901, 902} == {30, 31, 33}  # 32 is of that language


def test_network_tables_answer_as_the_network_does():
    """The tables give what embedding, filters, pooling and softmax give window by window, averaged by bytes."""
    net = language_cnn.ByteNetwork(["a", "b", "c"])
    texts = ["x", "ab" * 300, "é" * 97, prose(3, 90), "q" * language_cnn.WINDOW, prose(9, 9)]
    import pyarrow as pa

    from gridlore.llm.common import utf8

    got = net.probabilities(*utf8(pa.array(texts)), net.tables())
    for text, row in zip(texts, got, strict=True):
        data, total = text.encode(), 0
        for low in range(0, len(data), language_cnn.WINDOW):
            size = min(language_cnn.WINDOW, len(data) - low)
            places = size + 5 * (low + size == len(data))  # filters begin in the gap after a text, and end in the next window
            x = net.embedding[np.frombuffer(data[low : low + places + 4].ljust(places + 4, b"\0"), np.uint8)]
            pooled = [np.max([sum(x[i + j] @ f[j] for j in range(len(f))) for i in range(places)], axis=0) for f in net.filters]
            logits = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.top + net.top_bias
            chance = np.exp(logits - logits.max())
            total = total + size * chance / chance.sum()
        assert np.abs(total / total.sum() - row).max() < 1e-4


def test_no_documents_and_no_labels(spark, languages):
    docs = languages.where("doc_id < 0")
    assert language_cnn.identify_documents(docs).count() == 0 and language_cnn.keep_known(docs).count() == 0
    unknown = languages.where("doc_id >= 900").selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in language_cnn.identify_documents(unknown).collect()} == {"und"}
    assert {r["doc_id"] for r in language_cnn.keep_known(unknown).collect()} == {903, 904}


def test_network_gradients_are_those_of_its_loss():
    rng = np.random.default_rng(1)
    net = language_cnn.ByteNetwork(["a", "b"])
    for p in net._parameters():
        p[...] = p.astype(np.float32)
    windows, labels = rng.integers(0, 256, (6, language_cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        x = net.embedding[windows].astype(np.float64)
        pooled = [sum(x[:, j : x.shape[1] - len(f) + 1 + j] @ f[j] for j in range(len(f))).max(1) for f in net.filters]
        logits = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.top + net.top_bias
        return np.mean(np.log(np.exp(logits).sum(1)) - logits[np.arange(6), labels])

    gradients = net._gradients(windows, labels, np.ones(6, np.float32))
    for p, g in zip(net._parameters(), gradients, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, step = p[at], 1e-3  # smaller than the gaps between the answers that max pooling chooses from
        p[at] = before + step
        up = loss()
        p[at] = before - step
        down = loss()
        p[at] = before
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[500:560] = x[3]  # copies, which tie
    rows = [(k, [float(v) for v in r], 1) for k, r in enumerate(x)]
    rows += [(700, None, 1), (720, [0.0] * 16, 1), (740, [float("nan")] * 16, 1), (760, [None] + [1.0] * 15, 1), (780, [1.0] * 3, 1), (None, [1.0] * 16, 1), (800, [float("inf")] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    from pyspark.sql import functions as F

    got = {}
    for r in nearest_vectors(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    wide = x.astype(np.float64)
    assert set(got) == set(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        score = (wide * wide[q]).sum(1)
        order = [k for k in np.lexsort((np.arange(700), -score)) if k != q][:20]
        assert len(found) == 20 and found == sorted(found, key=lambda r: (-r[1], r[0]))
        assert all(s == score[k] for k, s in found)
        hits += len(set(order) & {k for k, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    assert [k for k, _ in got[520]][:20] == [3, *range(500, 519)]


@pytest.mark.parametrize("kind", ["clustered", "uniform", "of many norms"])
def test_search_stops_early_and_finds_enough(kind):
    """On 50,000 vectors of 64 numbers: at least 0.9 of the true neighbours, from a part of the points."""
    from gridlore.llm.ann_srs import ProjectedTree

    rng, n = np.random.default_rng(6), 50_000
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x = 0.5 * x + rng.normal(size=(300, 64))[rng.integers(0, 300, n)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "of many norms":
        x *= rng.uniform(0.5, 1.5, n)[:, None]
    tree, hits = ProjectedTree(np.arange(n), x, float((x * x).sum(1).max()) * (1 + 1e-12), 20), 0
    for q in range(0, n, 800):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score, kind="stable")[:20]) & set(tree.nearest(q, x[q], 20)[0]))
    share = tree.verified / tree.asked / n
    print(kind, "recall", hits / 20 / tree.asked, "verified", share)
    assert hits >= 0.9 * 20 * tree.asked
    assert share < {"clustered": 0.15, "uniform": 0.6, "of many norms": 0.85}[kind]


def test_neighbours_of_few_and_no_vectors(spark):
    from pyspark.sql import functions as F

    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest_vectors(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert nearest_vectors(few.where("vec_id > 5"), F.col("vec_id") == 0).count() == 0


def test_chi_square():
    assert abs(chi_square(7.344) - 0.5) < 1e-3 and chi_square(0.0) == 0
