"""Battery plans, cases like others, and periods over a stream."""

import datetime
import itertools
import math
import random
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.operators import battery_plan, case_search, timeline
from gridlore.schemas import ENERGY, SERIES
from gridlore.streaming import period_stream

START = datetime.datetime(2024, 1, 1)


def readings(spark, rows):
    base = dict.fromkeys(ENERGY.fieldNames())
    return spark.createDataFrame([(k, 1, *(base | r).values()) for k, r in enumerate(rows)], SERIES)


# -------------------------------------------------------------------- plans


def brute(needed, price, known, level, step, b):
    best = math.inf
    most, floor, roof = int(b.power * b.levels), min(level, math.ceil(b.low / 100 * b.levels)), max(level, int(b.high / 100 * b.levels))
    for moves in itertools.product(range(-most, most + 1), repeat=len(needed)):
        now, cost = level, 0.0
        for m, n, p, may in zip(moves, needed, price, known, strict=True):
            now -= m
            if (m and not may) or not floor <= now <= roof:
                break
            cost += p * max(0.0, n - m * step)
        else:
            if now >= level:
                best = min(best, cost)
    return best


def test_plans_equal_brute_force():
    rng = np.random.default_rng(1)
    b = battery_plan.Battery(levels=5, power=0.4)
    needed, price = rng.integers(0, 60, (40, 5)).astype(float), rng.integers(1, 6, (40, 5)).astype(float)
    level, step = rng.integers(0, 6, 40), rng.integers(1, 30, 40).astype(float)
    known = rng.random((40, 5)) < 0.8
    moves, cost = battery_plan.plan(needed, price, known, level, step, b)
    for k in range(40):
        assert cost[k] == pytest.approx(brute(needed[k], price[k], known[k], int(level[k]), step[k], b))
        assert cost[k] == pytest.approx(sum(price[k] * np.maximum(needed[k] - moves[k] * step[k], 0)))


def day(k, hours, soc=50.0, site="s"):
    return [{"timestamp": START + datetime.timedelta(days=k, hours=h), "site_id": site, "grid_import_kw": i, "battery_power_kw": p, "electricity_price": e, "battery_soc": soc, "battery_available_capacity_kwh": 100.0} for h, (i, p, e) in enumerate(hours)]


def test_a_day_that_follows_its_plan_saves_nothing(spark):
    """The plan is planned again as a day of readings: no saving. Charge stays within its bounds, and is not sold off."""
    rng = random.Random(2)
    days = [[(rng.uniform(0, 80), 0.0, rng.choice([1.0, 3.0, 5.0])) for _ in range(24)] for _ in range(6)]
    first = battery_plan.battery_plans(readings(spark, [r for k, d in enumerate(days) for r in day(k, d, 50.0 + 5 * k)])).orderBy("day").collect()
    again = []
    for k, (row, d) in enumerate(zip(first, days, strict=True)):
        assert row["saving"] > 0 and row["charge_last"] >= row["charge_first"] and all(20.0 <= x["charge"] <= 100.0 for x in row["plan"])
        again += day(k, [(max(0.0, i - x["power_kw"]), x["power_kw"], e) for (i, _, e), x in zip(d, row["plan"], strict=True)], 50.0 + 5 * k)
    for row, was in zip(battery_plan.battery_plans(readings(spark, again)).orderBy("day").collect(), first, strict=True):
        assert row["saving"] == pytest.approx(0, abs=1e-6) and row["cost_before"] == pytest.approx(was["cost_planned"])


def test_plans_of_odd_days(spark):
    """Nulls, one hour, a flat price, an empty battery, no rows."""
    rows = day(0, [(None, None, None)]) + day(1, [(10.0, None, 4.0)]) + day(2, [(10.0, 0.0, 2.0)] * 24) + day(3, [(10.0, 0.0, 1.0), (10.0, 0.0, 9.0)], 0.0) + [{"site_id": "s"}]
    got = battery_plan.battery_plans(readings(spark, rows)).orderBy("day").collect()
    assert [r["day"].day for r in got] == [1, 2, 3, 4]
    assert got[0]["plan"] == [] and got[0]["saving"] == 0 and got[1]["saving"] == 0 and got[2]["saving"] == pytest.approx(0)
    assert got[3]["saving"] == pytest.approx(10 * 9 - 10 * 1) and got[3]["charge_last"] == 0
    assert battery_plan.battery_plans(readings(spark, [])).count() == 0


# -------------------------------------------------------------------- cases


def brute_similar(cases, asked, k, most):
    def of(case):
        text = lambda x: set(re.findall(r"[^\W_]+", (x or "").lower()))
        return {"symptoms": text(case[2]), "root_cause": text(case[3]), "operator_action": text(case[4]), "tags": {t.strip().lower() for t in case[5] or [] if t and t.strip()}}

    terms = {c[0]: of(c) for c in cases}
    count = {}
    for t in terms.values():
        for f, values in t.items():
            for v in values:
                count[f, v] = count.get((f, v), 0) + 1
    weight = {x: round(1000 * math.log1p(len(cases) / n)) for x, n in count.items() if n <= most}
    kinds, out = {c[0]: c[1] for c in cases}, set()
    for q in asked:
        found = []
        for c in terms:
            like, shares = {"event_type": float(kinds[q] is not None and kinds[q] == kinds[c])}, 0
            for f in case_search.FIELDS:
                w = lambda s, f=f: sum(weight.get((f, x), 0) for x in s)
                both = w(terms[q][f] & terms[c][f])
                shares += both
                like[f] = both / (w(terms[q][f]) + w(terms[c][f]) - both) if both else 0.0
            if shares and c != q:
                score = case_search.EVENT_TYPE * like["event_type"]
                for f, x in case_search.FIELDS.items():
                    score += x * like[f]
                found.append((-score, c, [f for f in like if like[f] > 0]))
        for rank, (score, c, matching) in enumerate(sorted(found)[:k], 1):
            out.add((q, rank, c, round(-score, 9), tuple(matching)))
    return out


@pytest.mark.parametrize("most", [2000, 12])
def test_similar_cases_equal_brute_force(spark, most):
    """Ties, nulls, repeated words, common words without weight, a case like no other."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices(["Fan", "fault", "hot", "cell", "the", "relay", "3.2V", "漏", "x_y"], k=n)) if n else None
    cases = [(k, rng.choice(["a", "b", None]), text(rng.randint(0, 6)), text(rng.randint(0, 3)), text(rng.randint(0, 2)), rng.choice([None, [], ["T1", " t1 ", ""], ["t2", "t3"]])) for k in range(60)]
    cases += [(60, "a", "the unlike", None, None, None), (61, "a", None, None, None, None), (62, "b", cases[3][2], cases[3][3], cases[3][4], cases[3][5])]
    table = spark.createDataFrame(cases, "case_id long, event_type string, symptoms string, root_cause string, operator_action string, tags array<string>")
    got = case_search.similar_to(table, table.where("case_id % 7 = 3 OR case_id >= 60"), 4, most).collect()
    want = brute_similar(cases, [k for k in range(63) if k % 7 == 3 or k >= 60], 4, most)
    assert {(r["query_id"], r["rank"], r["case_id"], round(r["score"], 9), tuple(r["matching"])) for r in got} == want
    assert all(sorted([*r["matching"], *r["differing"]]) == sorted(["event_type", *case_search.FIELDS]) for r in got)


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    rows = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(rows.apply(k).totalShuffleWrite() for k in range(rows.size()))


def test_pairs_of_similar_cases_are_not_shuffled(spark, monkeypatch):
    """600 cases of which all meet all, in many blocks: lists are shuffled, and the best of each block."""
    monkeypatch.setattr(case_search, "SMALL_ENTRIES", 1000, raising=False)
    rng = random.Random(6)
    cases = [(k, rng.choice(["a", None]), " ".join(rng.choices([f"w{n}" for n in range(12)], k=8)), f"c {k % 3}", None, None) for k in range(600)]
    table = spark.createDataFrame(cases, "case_id long, event_type string, symptoms string, root_cause string, operator_action string, tags array<string>").cache()
    table.count()
    before = shuffled(spark)
    got = case_search.similar_to(table, table, 3).collect()
    assert shuffled(spark) - before < 1_500_000
    few = {r for r in brute_similar(cases, range(0, 600, 60), 3, 2000)}
    assert {(r["query_id"], r["rank"], r["case_id"], round(r["score"], 9), tuple(r["matching"])) for r in got if r["query_id"] % 60 == 0} == few
    assert len(got) == 1800


def test_words_of_very_many_cases_count(spark, monkeypatch):
    """2,100 cases have a word; some share nothing else. Many blocks, little kept and met at once."""
    for name, value in {"BLOCK_ENTRIES": 4000, "BLOCK_VALUES": 300, "KEPT": 500, "TOGETHER": 90}.items():
        monkeypatch.setattr(case_search, name, value, raising=False)
    rng = random.Random(8)
    text = lambda k: " ".join(["fault", *rng.choices([f"w{n}" for n in range(40)], k=rng.randint(0, 5)), *([f"own{k}"] if k % 3 else [])])
    cases = [(k, rng.choice(["a", "b", None]), text(k), rng.choice([None, "fan", "cell hot"]), rng.choice([None, "reset"]), rng.choice([None, ["t1"], ["t1", "t2"]])) for k in range(2097)]
    cases += [(2097, "c", "fault", None, None, None), (2098, "c", "fault alone", None, None, None), (2099, None, None, None, None, ["none like it"])]
    table = spark.createDataFrame(cases, "case_id long, event_type string, symptoms string, root_cause string, operator_action string, tags array<string>")
    asked = [k for k in range(2100) if k % 210 == 0 or k >= 2097]
    got = case_search.similar_to(table, table.where(F.col("case_id").isin(asked)), 4).collect()
    assert {(r["query_id"], r["rank"], r["case_id"], round(r["score"], 9), tuple(r["matching"])) for r in got} == brute_similar(cases, asked, 4, math.inf)
    assert {r["query_id"] for r in got} == {*asked} - {2099}


# ------------------------------------------------------------------ streams


def test_periods_over_a_stream(spark, tmp_path):
    """Several batches out of order, a stop and a restart from the checkpoint, a late row that is counted."""
    rng = random.Random(9)
    period_stream.prepared_session(spark)
    rows = []
    for k in range(240):
        rows.append({"timestamp": START + datetime.timedelta(minutes=10 * k), "site_id": f"s{k % 2}", "battery_soc": rng.choice([5.0, 5.0, 60.0]), "electricity_price": rng.choice([5.0, 1.0]), "battery_power_kw": -1.0})
    table = readings(spark, rows)
    names = ["LOW_SOC_RISK", "PEAK_PERIOD_ABNORMAL_CHARGING"]
    want = {tuple(r) for r in timeline.periods(table, names).select("rule", "site_id", "start_time", "end_time", "readings").collect()}
    folder = tmp_path / "in"
    folder.mkdir()
    number = itertools.count()

    def put(df):
        name = f"{tmp_path}/w{next(number)}"
        df.coalesce(1).write.parquet(name)
        (part,) = (p for p in __import__("pathlib").Path(name).glob("*.parquet"))
        shutil.move(part, folder / f"{next(number):05}.parquet")

    def drain():
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = period_stream.period_stream(stream, "2 hours", rules=names)
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination(120)
        assert query.exception() is None
        return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)

    # Each file holds 40 readings, some of which belong before those of the file before it.
    order = sorted(range(240), key=lambda k: k + 6 * (k % 3))
    dropped = 0
    for low in range(0, 240, 40):
        put(table.where(F.col("id").isin(order[low : low + 40])))
        if low == 80:
            dropped += drain()
    dropped += drain()
    assert dropped == 0
    put(readings(spark, [{"timestamp": START, "site_id": "s0", "battery_soc": 5.0}]))  # days late
    put(readings(spark, [{"timestamp": START + datetime.timedelta(days=30), "site_id": "end", "battery_soc": 60.0}]))
    assert drain() == 2
    put(readings(spark, [{"timestamp": START + datetime.timedelta(days=31), "site_id": "end", "battery_soc": 60.0}]))
    drain()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").selectExpr("rule", "site_id", "cast(start_time as timestamp_ntz)", "cast(end_time as timestamp_ntz)", "readings").collect()}
    assert got == want and len(want) > 20
