"""Binned interval joins, running totals, and windows over files of many pages."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridlore.operators import chunking, versions
from gridlore.operators.intervals import bin_width, overlap_join, running_total
from gridlore.schemas import PAGES
from gridlore.sources.documents import cases_in_series


def pairs(left, right):
    return sorted(
        (i, j) for i, k, a, b in left for j, m, c, d in right
        if k is not None and k == m and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b
    )


@pytest.mark.parametrize("width", [None, 0.7, 13.0, 1e6])
def test_overlap_join_equals_brute_force(spark, width):
    """One hot key, long and short intervals, points, nulls, ends that only touch; no pair twice."""
    rng = random.Random(4)

    def rows(n, longest):
        out = []
        for k in range(n):
            a = round(rng.uniform(-50, 50), 1)
            out.append((k, rng.choice(["hot"] * 6 + ["b", "c", None]), a, rng.choice([a, a + rng.randint(0, longest), a + 0.5, a + 90, a - 1, None])))
        return [*out, (n, "hot", None, 3.0), (n + 1, "hot", 0.0, 0.0), (n + 2, "hot", -200.0, 200.0)]

    left, right = rows(120, 3), rows(90, 20)
    table = lambda r, i: spark.createDataFrame(r, f"{i} int, k string, {i}0 double, {i}1 double")
    got = overlap_join(table(left, "a"), table(right, "b"), ["k"], ("a0", "a1"), ("b0", "b1"), width)
    assert got.columns == ["a", "k", "a0", "a1", "b", "b0", "b1"]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == pairs(left, right)


def test_overlap_join_of_points_of_empty_sides_and_of_clashing_names(spark):
    points = spark.createDataFrame([(k, k % 2, k % 5) for k in range(20)], "a int, k int, x int")
    same = points.select(F.col("a").alias("b"), "k", F.col("x").alias("y"))
    assert overlap_join(points, same, ["k"], ("x", "x"), ("y", "y")).count() == sum(p % 2 == q % 2 and p % 5 == q % 5 for p in range(20) for q in range(20))
    assert overlap_join(points.limit(0), same, ["k"], ("x", "x"), ("y", "y")).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        overlap_join(points, points, ["k"], ("x", "x"), ("x", "x"))
    with pytest.raises(ValueError, match="different kinds"):
        overlap_join(points, same.withColumn("d", F.current_date()), ["k"], ("x", "x"), ("y", "d"))


def test_long_intervals_meet_few_bins_on_average(spark):
    rows = spark.createDataFrame([(k, float(k), float(k) + (100_000 if k % 100 == 0 else 1)) for k in range(1000)], "i int, a double, b double")
    wide = bin_width((rows, F.col("a"), F.col("b")))
    assert rows.select(F.sum(F.floor(F.col("b") / wide) - F.floor(F.col("a") / wide) + 1)).first()[0] <= 3 * 1000


def test_cases_meet_readings_of_their_range(spark):
    """A hot dataset, a range over all its readings, and ranges that none is in."""
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    series = spark.createDataFrame([(k, 1 if k % 10 else 2, at(k)) for k in range(500)], "id int, dataset_id long, timestamp timestamp_ntz")
    spans = [("all", 1, 0, 500), ("some", 1, 17, 40), ("other", 2, 0, 100), ("none", 2, 600, 700), ("point", 1, 33, 33), ("absent", None, 0, 9)]
    cases = spark.createDataFrame([(c, d, (at(a), at(b)), "x") for c, d, a, b in spans], "case_id string, related_dataset_id long, related_time_range struct<start: timestamp_ntz, end: timestamp_ntz>, tags string")
    got = cases_in_series(cases, series)
    assert got.columns == ["id", "dataset_id", "timestamp", "case_id"]
    want = sorted((c, k) for c, d, a, b in spans for k in range(500) if a <= k <= b and (1 if k % 10 else 2) == d)
    assert sorted((r["case_id"], r["id"]) for r in got.collect()) == want


def test_labels_of_chunks_over_many_pages(spark):
    pages = spark.createDataFrame([(f, k, k + 1, str(k) if k % 3 else None) for f in "ab" for k in range(200)], "source_filename string, page_index int, pdf_page_number int, printed_page_number string")
    chunks = spark.createDataFrame([("whole", "a", 0, 199), ("one", "a", 7, 7), ("two", "b", 5, 6), ("gone", "c", 0, 9)], "chunk_id string, source_filename string, page_index_start int, page_index_end int")
    got = {r[0]: r[1] for r in versions.page_label_map(chunks, pages).collect()}
    assert got["whole"] == {str(k + 1): (str(k) if k % 3 else None) for k in range(200)}
    assert got["one"] == {"8": "7"} and got["two"] == {"6": "5", "7": None} and "gone" not in got


@pytest.mark.parametrize("together", [1, 3, 4096])
def test_running_totals(spark, together):
    rng = random.Random(together)
    rows = [(k, p, rng.randint(0, 9)) for k in ("a", "b", None) for p in rng.sample(range(100), 30)]
    got = running_total(spark.createDataFrame(rows, "k string, p int, v int"), "k", "p", F.col("v"), "t", together).collect()
    assert {(r["k"], r["p"]): r["t"] for r in got} == {(k, p): sum(v for m, q, v in rows if m == k and q < p) for k, p, _ in rows}


@pytest.mark.parametrize("size, overlap", [(10, 3), (25, 0), (7, 6), (100, 20), (4, 9)])
def test_fixed_windows_over_many_pages(spark, size, overlap):
    """Empty and long pages, windows over many pages and many windows in a page, blank windows, several files."""
    rng = random.Random(size)
    files = {f: ["".join(rng.choices("ab é漢 \n", k=rng.choice([0, 1, 3, 8, 60, 400]))) if rng.random() < 0.8 else " " * 150 for _ in range(n)] for f, n in (("x", 40), ("y", 1), ("z", 9))}
    rows = [(f, 3 * k, 3 * k + 1, f"l{k}" if k % 4 else None, f"t{k}" if k % 5 else None, "text", "text_layer", t, len(t), 0.0) for f, pages in files.items() for k, t in enumerate(pages)]
    got = {r["chunk_id"]: r for r in chunking.chunk_fixed(spark.createDataFrame(rows, PAGES), chunking.Strategy("s", "fixed", size, overlap)).collect()}
    want = {}
    for f, pages in files.items():
        whole, ends, at, n = "".join(t + "\n" for t in pages), [], 0, 0
        for t in pages:
            ends.append((at, at + len(t) + 1))
            at += len(t) + 1
        start = 0
        while start < len(whole):
            text = whole[start : start + size]
            on = [k for k, (a, b) in enumerate(ends) if a < start + len(text) and b > start]
            if text.strip():
                want[f"{f}::s::prose::{n:04d}"] = (text, 3 * on[0], 3 * on[-1], sorted({f"l{k}" for k in on if k % 4}), f"t{on[0]}" if on[0] % 5 else None)
                n += 1
            if start + size >= len(whole):
                break
            start += max(1, size - overlap)
    fields = ("text", "page_index_start", "page_index_end", "printed_page_number_list", "section_title")
    if overlap < size:
        assert {k: tuple(r[c] for c in fields) for k, r in got.items()} == want
    else:  # a step of one character goes on to the last one
        assert set(want) <= set(got)
    assert all(r["char_count"] == len(r["text"]) <= size for r in got.values())
