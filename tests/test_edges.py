"""Uploads of several splits, many keywords, readers kept by workers, finite numbers, prices by sketches."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.operators import keywords, retrieval, rules, schedule
from gridlore.schemas import ENERGY, PAGES, SERIES, assert_schema
from gridlore.sources import documents as D
from gridlore.sources import energy_csv, store

# ---------------------------------------------------------------------- CSV


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "900")
    yield
    spark.conf.set(name, before)


def lines(n):
    rng = random.Random(n)
    for k in range(n):
        yield f"2024-01-01 00:{k % 60:02d},site {rng.randrange(10**rng.randrange(1, 9))},{k}," + ("bad" if k % 50 == 7 else "1")
        if k % 37 == 0:
            yield ""


def test_rows_of_many_splits_are_numbered_as_of_one(spark, tmp_path, small_splits):
    path = tmp_path / "a.csv"
    path.write_text("timestamp,site_id,load_kw,electricity_price\n" + "\n".join(lines(400)) + "\n")
    rows = energy_csv.read_csv(spark, str(path))
    assert rows.rdd.getNumPartitions() > 5
    assert {r["row"]: r["load_kw"] for r in rows.collect()} == {k + 2: str(k) for k in range(400)}


def test_a_file_with_feeds_in_quotes_is_read_whole(spark, tmp_path, small_splits):
    path = tmp_path / "a.csv"
    path.write_text("timestamp,site_id,load_kw\n" + "".join(f'2024-01-01,"a\nb{k}",{k}\n' for k in range(100)) + '2024-01-01,"say ""x""",100\n')
    rows = energy_csv.read_csv(spark, str(path))
    assert rows.rdd.getNumPartitions() == 1
    got = rows.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(2, 103)) and got[3]["site_id"] == "a\nb3" and [r["load_kw"] for r in got] == [str(k) for k in range(101)]


def test_an_upload_of_many_splits(spark, tmp_path, small_splits, monkeypatch):
    """Ids follow the rows, every warning is kept as a row, and only the first are returned."""
    monkeypatch.setattr(store, "MOST_ROWS", 5)
    path = tmp_path / "a.csv"
    path.write_text("timestamp,site_id,load_kw,electricity_price\n" + "\n".join(lines(400)) + "\n" + "never,s,1,1\n")
    at = f"{tmp_path}/store"
    r = store.ingest_csv(spark, at, str(path))
    assert (r.row_count, r.inserted_count, r.status, len(r.warnings)) == (401, 400, "success_with_warnings", 5)
    got = store.series(spark, at).orderBy("id").collect()
    assert [x["id"] for x in got] == list(range(1, 401)) and [x["load_kw"] for x in got] == [float(k) for k in range(400)]
    kept = store.warnings(spark, at, r.dataset_id).collect()
    assert len(kept) == r.warning_count == 22 + 1 + 8 and [w.asDict() for w in kept[:5]] == r.warnings
    assert [w["row"] for w in kept if w["column"] == "electricity_price"] == [k + 2 for k in range(400) if k % 50 == 7]
    second = store.ingest_csv(spark, at, str(path))
    assert second.dataset_id == 2 and store.series(spark, at).where("dataset_id = 2").agg(F.min("id")).first()[0] == 401


# ----------------------------------------------------------------- keywords


def test_many_keywords_are_found_as_one_by_one(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé漢 ", k=rng.randint(1, 5))) for _ in range(10_000)]
    texts = [(k, "".join(rng.choices("abcé漢 ", k=rng.choice([0, 5, 60])))) for k in range(60)] + [(60, None)]
    table = spark.createDataFrame([(k, t, 1) for k, t in texts], "query_id int, text string, rank int")
    vocabulary = keywords.vocabulary(spark.createDataFrame([(w,) for w in words], "keyword string"))
    assert vocabulary == sorted(set(words))
    got = {r["query_id"]: r["found"] for r in keywords.with_found(table, "text", vocabulary).collect()}
    assert got == {k: [w for w in vocabulary if t and w in t] for k, t in texts}
    assert keywords.with_found(table, "text", []).where(F.size("found") > 0).count() == 0


@pytest.mark.parametrize("most", [200_000, 3])
def test_coverage_with_and_without_the_automaton(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "MOST_KEYWORDS", most)
    ranked = spark.createDataFrame([(1, "abcd", 1), (1, "xyz", 2), (1, "late", 3), (2, None, 1), (3, "ab", 1)], "query_id int, text string, rank int")
    asked = spark.createDataFrame([(1, ["bc", "yz", "late", "", "bc"], 0.8), (2, ["a", ""], None), (3, [], 0.0), (4, ["q"], 0.1), (5, None, 0.1)], "query_id int, keywords array<string>, threshold double")
    got = {r["query_id"]: (r["coverage"], r["success"]) for r in retrieval.keyword_coverage(ranked, asked, "rank", 2).collect()}
    assert got == {1: (0.75, False), 2: (0.0, False), 3: (0.0, False), 4: (0.0, False), 5: (0.0, False)}


# ------------------------------------------------------------------ readers


def test_a_worker_builds_its_reader_once(spark, tmp_path):
    """Several partitions, batches and jobs: never more readers than workers; none where no page is scanned."""
    log = f"{tmp_path}/built"

    def build():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda name, page: [f"{name} page {page} was recognised as text"]

    rows = [("f", k, k + 1, None, None, "scanned" if k % 2 else "text", "none", "", 0, 0.9) for k in range(200)]
    pages = spark.createDataFrame(rows, PAGES)
    for _ in range(3):
        done = D.recognise(pages.repartition(8), build=build, key=log).where("page_status = 'text' AND extraction_method = 'ocr'").collect()
        assert len(done) == 100
    with open(log) as f:
        built = f.read().split()
    assert len(built) == len(set(built)) <= 8
    none = D.recognise(pages.where("page_status = 'text'"), build=lambda: 1 / 0, key="never")
    assert none.count() == 100
    with pytest.raises(ValueError):
        D.recognise(pages)


# ------------------------------------------------------------------- prices


def test_numbers_must_be_finite_at_the_edge(spark):
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.FloatType()), T.StructField("s", T.StringType())])
    table = lambda *rows: spark.createDataFrame(rows, schema)
    assert_schema(table((1.0, None, "x"), (None, 2.0, "nan")), schema, finite=True)
    assert_schema(table((float("inf"), 1.0, "x")), schema)
    with pytest.raises(ValueError, match=r"a \(2\), b \(1\)"):
        assert_schema(table((float("inf"), float("nan"), "x"), (float("-inf"), 1.0, "x")), schema, finite=True)


def priced(spark, prices):
    base = dict.fromkeys(ENERGY.fieldNames())
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, d, *(base | {"timestamp": at + datetime.timedelta(hours=k), "site_id": "s", "electricity_price": p, "battery_power_kw": -1.0, "battery_soc": 50.0}).values()) for k, (d, p) in enumerate(prices)]
    return spark.createDataFrame(rows, SERIES)


def test_sketched_quartiles_are_near_the_exact_ones(spark):
    """Merged from days, their ranks are within 0.5 % of all prices; a dataset without prices has no band."""
    rng = random.Random(3)
    prices = [(1, rng.lognormvariate(1, 1)) for _ in range(20_000)] + [(2, None)] * 5 + [(3, 7.0)] * 4 + [(3, None)]
    table = priced(spark, prices)
    daily = rules.price_sketches(table)
    assert daily.where("dataset_id = 1").count() > 800
    got = {r["dataset_id"]: (r["price_low"], r["price_high"]) for r in rules.sketched_bands(daily).collect()}
    assert set(got) == {1, 3} and got[3] == (7.0, 7.0)
    own = sorted(p for d, p in prices if d == 1)
    for price, share in zip(got[1], (0.25, 0.75), strict=True):
        assert abs(sum(p <= price for p in own) / len(own) - share) <= 0.01


def test_rules_by_own_prices(spark):
    table = priced(spark, [(1, 100.0 + k) for k in range(8)] + [(2, 0.01 * k) for k in range(8)] + [(4, None)])
    own = rules.with_own_bands(table, rules.price_bands(table))
    found = rules.anomalies(own, rules.OWN_BANDS).where("rule = 'PEAK_PERIOD_ABNORMAL_CHARGING'").groupBy("dataset_id").count().collect()
    assert {r["dataset_id"]: r["count"] for r in found} == {1: 2, 2: 2}
    plain = rules.anomalies(table).where("rule = 'PEAK_PERIOD_ABNORMAL_CHARGING'").groupBy("dataset_id").count().collect()
    assert {r["dataset_id"]: r["count"] for r in plain} == {1: 8}
    charged = schedule.suggestions(own, rules.OWN_BANDS).where("action = 'charge'").groupBy("dataset_id").count().collect()
    assert {r["dataset_id"]: r["count"] for r in charged} == {1: 2, 2: 2}


def test_what_the_battery_does_already_is_not_counted_again(spark):
    base = dict.fromkeys(ENERGY.fieldNames()) | {"site_id": "s", "grid_import_kw": 90.0, "contract_capacity_kw": 100.0, "electricity_price": 4.0, "load_kw": 10.0}
    rows = [(20.0, 60.0), (-20.0, 60.0), (5.0, 10.0)]  # discharges as suggested; charges instead; runs though it should idle
    at = datetime.datetime(2024, 1, 1)
    table = spark.createDataFrame([(k, 1, *(base | {"timestamp": at + datetime.timedelta(days=k), "battery_power_kw": p, "battery_soc": soc}).values()) for k, (p, soc) in enumerate(rows)], SERIES)
    got = [(r["cost_before"], r["cost_after"]) for r in schedule.before_after(table).orderBy("day").collect()]
    assert got == [(360.0, 360.0), (360.0, 200.0), (360.0, 380.0)]
