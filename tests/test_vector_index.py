"""Inverted lists against all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.operators import retrieval, vector_index


def table(spark, x, name="chunk_id", vector="embedding"):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({name: [f"{k:06}" for k in range(len(x))], vector: [v.tolist() for v in x]}))


def shapes(n, d, rng):
    centres = rng.normal(size=(60, d)) * 3
    return {"clustered": centres[rng.integers(0, 60, n)] + rng.normal(size=(n, d)), "uniform": rng.normal(size=(n, d))}


def pairs(found):
    return {(r["query_id"], r["chunk_id"]) for r in found.select("query_id", "chunk_id").collect()}


@pytest.mark.parametrize("shape", ["clustered", "uniform"])
def test_recall_of_calibrated_lists(spark, shape):
    """At least 0.9 of the 30 nearest of all rows; the share of rows met is stated in README."""
    x = shapes(8000, 24, np.random.default_rng(7))[shape]
    chunks, queries = table(spark, x), table(spark, x[::80] + 0.05, "query_id", "query_vector")
    centres = vector_index.fit(chunks, "chunk_id")
    listed = vector_index.in_lists(chunks, centres).cache()
    assert listed.count() == 8000 and len(centres.vectors) == 89
    want = pairs(retrieval.candidates(chunks, queries))
    got = pairs(vector_index.search(listed, queries, centres))
    recall, sizes = len(want & got) / len(want), {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    met = np.argsort(-(unit(x[::80] + 0.05) @ centres.vectors.T), axis=1)[:, : centres.probes]
    share = np.mean([sum(sizes.get(int(c), 0) for c in row) for row in met]) / 8000
    print(f"{shape}: recall {recall:.3f}, {centres.probes} of {len(centres.vectors)} lists, {share:.3f} of the rows met")
    assert len(want) == 3000 and recall >= 0.9 and share < (0.3 if shape == "clustered" else 0.9)
    exact = vector_index.search(listed, queries, vector_index.with_radii(listed, centres), probes=2, exact=True)
    assert pairs(exact) == want


def test_a_hot_list_is_several_blocks(spark, monkeypatch):
    """Most rows lie around one centre; blocks stay small, and nothing is lost."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=8) + 0.05 * rng.normal(size=(600, 8)), rng.normal(size=(100, 8))])
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", 400)
    monkeypatch.setattr(vector_index, "MOST_QUESTIONS", 7)
    chunks, queries = table(spark, x), table(spark, x[::20], "query_id", "query_vector")
    centres = vector_index.fit(chunks, "chunk_id", k=5)
    listed = vector_index.in_lists(chunks, centres)
    exact = vector_index.search(listed, queries, vector_index.with_radii(listed, centres), 5, exact=True)
    assert pairs(exact) == pairs(retrieval.candidates(chunks, queries, 5))


def test_odd_vectors(spark):
    """Null, zero and shorter vectors are in no list; few rows, inactive rows, and none at all."""
    rows = [("a", [1.0, 0.0], True, 1), ("b", None, True, 2), ("c", [0.0, 0.0], True, 3), ("d", [1.0], True, 4), ("e", [0.0, 1.0], True, 5), ("f", [1.0, 0.1], False, 6)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, is_active boolean, list int").drop("list")
    queries = spark.createDataFrame([("q", [1.0, 0.05]), ("n", None), ("z", [0.0, 0.0])], "query_id string, query_vector array<double>")
    centres = vector_index.fit(chunks, "chunk_id", k=2)
    listed = vector_index.in_lists(chunks, centres)
    assert sorted(r["chunk_id"] for r in listed.collect()) == ["a", "e", "f"]
    got = vector_index.search(listed, queries, vector_index.with_radii(listed, centres), 2, exact=True).orderBy("vector_rank").collect()
    assert [(r["query_id"], r["vector_rank"], r["chunk_id"]) for r in got] == [("q", 1, "a"), ("q", 2, "e")]
    with pytest.raises(ValueError):
        vector_index.search(listed, queries, centres, exact=True)
    none = chunks.where(F.lit(False))
    assert vector_index.search(vector_index.in_lists(none, vector_index.fit(none, "chunk_id")), queries, centres, 2).count() == 0
