"""Empty tables, texts of great length, labels of one kind, repeated ids, many blocks."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridlore.llm import ann_srs, language_cnn, packing, quality_pu, toxicity_automata
from gridlore.llm import queries as Q
from gridlore.llm.url_markov import judge_urls

from .conftest import prose

LABELS = "doc_id long, quality int, toxic int"
SCORERS = [quality_pu.score_documents, toxicity_automata.score_documents]


@pytest.fixture(scope="module")
def labelled():
    texts = [prose(k, 30) + (" vileword horridterm" if k % 3 == 0 else "") + (" $$$ ###" * 9 if k % 2 else "") for k in range(120)]
    return texts, [(k, k % 2 ^ 1, int(k % 3 == 0)) for k in range(120)]


@pytest.mark.parametrize("score", SCORERS)
def test_scores_of_long_texts_nulls_and_no_documents(spark, make_docs, labelled, score):
    texts, marks = labelled
    labels = spark.createDataFrame(marks, LABELS)
    long = prose(500, 150_000)
    docs = make_docs([*texts, long, None, "", (7, texts[7])])
    got = score(docs, labels).collect()
    assert len(got) == len(texts) + 4 and all(0 <= r["score"] <= 1 for r in got)
    same = {round(r["score"], 9) for r in got if r["doc_id"] == 7}
    assert len(same) == 1  # repeated rows are judged alike
    assert score(make_docs([]), labels).count() == 0


@pytest.mark.parametrize("score", SCORERS)
@pytest.mark.parametrize("marks", [[], [(k, 0, 0) for k in range(60)], [(k, 1, 1) for k in range(60)], [(k, None, None) for k in range(60)]])
def test_labels_of_one_kind_or_none(spark, make_docs, labelled, score, marks):
    got = score(make_docs(labelled[0][:60]), spark.createDataFrame(marks, LABELS)).collect()
    assert len(got) == 60 and all(0 <= r["score"] <= 1 for r in got)


def test_a_long_toxic_text_is_told_by_its_end(spark, make_docs, labelled):
    """Whole texts are read, not their beginnings."""
    texts, marks = labelled
    docs = make_docs([*texts, prose(600, 3000) + " vileword horridterm" * 200, prose(600, 3000)])
    got = {r["doc_id"]: r["score"] for r in toxicity_automata.score_documents(docs, spark.createDataFrame(marks, LABELS)).collect()}
    assert got[120] > got[121]


# --------------------------------------------------------------------- URLs


def test_urls_of_one_class_and_a_long_one(spark):
    rows = [(k, f"http://good{k % 7}.com/{k}") for k in range(60)] + [(100, "http://x.org/" + "a/b?c" * 20_000), (101, "http://y.org/z")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["path"]) for r in judge_urls(pages, [("allow", "com", "/")]).collect()}
    assert len(got) == 62 and {v for v, _ in got.values()} == {"allow"} and got[100][1] == "/a/b"


def test_url_sql(spark):
    """The models, written out in SQL, give the same verdicts and scores."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    run = con.execute(Q.oracle_sql()["op7_url_filter"])
    names = [x[0] for x in run.description]
    got = Q.op7_url_filter(spark, sf)
    assert sorted(got.columns) == sorted(names)
    order = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=order) == sorted(run.fetchall(), key=order)


# ---------------------------------------------------------------- languages


def test_no_language_is_left_out_by_chance(spark, monkeypatch):
    """One text a language is expected, and one is got; languages without a letter are none."""
    monkeypatch.setattr(language_cnn, "TEXTS_PER_LANGUAGE", 1)
    monkeypatch.setattr(language_cnn, "EPOCHS", 1)
    rows = [(40 * n + k, prose(n, 12), f"l{n}") for n in range(12) for k in range(40)] + [(900 + k, "12 34", "numbers") for k in range(9)]
    network = language_cnn.train_network(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert network.languages == sorted(f"l{n}" for n in range(12))


# ---------------------------------------------------------------- neighbours


def test_neighbours_over_many_blocks(spark, monkeypatch):
    """Recall against all rows, through the whole operator; a repeated id is a candidate for each of its rows."""
    monkeypatch.setattr(ann_srs, "BLOCK_NUMBERS", 16 * 150)
    monkeypatch.setattr(ann_srs, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1000, 16))
    ids = [*range(1000), 7]
    x = np.concatenate([x, rng.normal(size=(1, 16))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = ann_srs.nearest_vectors(table, F.col("vec_id") % 10 == 0, k=10).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add((r["vec_id"], round(r["score"], 9)))
    hits = 0
    for q in range(0, 1000, 10):
        scores = sorted(((-(x[k] @ x[q]), ids[k]) for k in range(1001) if ids[k] != q))[:10]
        hits += len(found[q] & {(i, round(-s, 9)) for s, i in scores})
    assert len(found) == 100 and hits / 1000 >= 0.9


# ------------------------------------------------------------------- packing


def test_repeated_ids_are_packed_each(make_docs):
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    docs = make_docs([(3, "one two"), (3, "one two"), (3, "three four five"), (None, "six")])
    got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special).collect()
    assert sum(r["length"] for r in got) == sum({(r["doc_id"], r["doc_tokens"], r["sequence_id"], r["offset"]): r["length"] for r in got}.values())
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) >= 4


# ------------------------------------------------------------------ pipeline


def test_the_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
