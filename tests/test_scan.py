"""Ranks and running values over ranges, against plain loops: hot groups, ties, nulls, empty tables."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger, scan

DAY = dt.datetime(2020, 1, 1)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 0.5, -1.0, 2.0, rng.random()]), DAY + dt.timedelta(hours=rng.randint(0, 200))) for i in range(n)]


SCHEMA = "id long, k string, v double, at timestamp"


def test_ranks_and_running_values(spark):
    rows = rows_of(700)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r for r in scan.ranked(df, [F.col("at"), F.col("id")], "place", ["k"]).collect()}
    run = {r["id"]: r for r in scan.running(df, ["k"], [F.col("at"), F.col("id")], {"total": F.col("v")}, {"top": F.col("total")}).collect()}
    for key in ("hot", "a", None):
        total, top = 0.0, None
        for place, r in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (r[3], r[0])), 1):
            total += r[2] or 0.0
            top = total if top is None else max(top, total)
            assert got[r[0]]["place"] == place and run[r[0]]["total"] == pytest.approx(total) and run[r[0]]["top"] == pytest.approx(top)
    whole = {r["id"]: r["rank"] for r in scan.ranked(df, [F.col("v").desc_nulls_last(), F.col("id")]).collect()}
    assert [i for i, _ in sorted(whole.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))]
    empty = df.limit(0)
    assert scan.ranked(empty, [F.col("id")]).count() == 0 and scan.running(empty, ["k"], [F.col("id")], {"t": F.col("v")}).count() == 0


def test_shared_ranks(spark):
    rows = rows_of(400, 2)
    got = {r["id"]: r["rank"] for r in scan.value_ranks(spark.createDataFrame(rows, SCHEMA), ["k"], "v", "rank").collect()}
    for i, k, v, _ in rows:
        mine = [w for _, l, w, _ in rows if l == k and w is not None]
        assert got[i] == (None if v is None else sum(w < v for w in mine) + (mine.count(v) + 1) / 2)


def test_known_before(spark):
    rows = rows_of(300, 3) + [(900, "same", 0.1, DAY), (901, "same", 0.1, DAY + dt.timedelta(1)), (902, "same", 0.1, DAY + dt.timedelta(2)), (903, "same", None, DAY + dt.timedelta(2, 5))]
    df = spark.createDataFrame(rows, SCHEMA)
    for r in scan.known_before(df, df, ["k"], "at", "v").collect():
        before = [v for _, k, v, at in rows if k == r["k"] and at < r["at"] and v is not None]
        assert r["prior_n"] == len(before)
        assert r["prior_mean"] == (pytest.approx(statistics.mean(before)) if before else None)
        assert r["prior_sd"] == (pytest.approx(statistics.stdev(before), abs=1e-9) if len(before) > 1 else None)
    assert {r["prior_sd"] for r in scan.known_before(df, df, ["k"], "at", "v").where("id in (902, 903)").collect()} == {0.0}


def test_known_before_broadcasts_nothing(spark):
    rows = spark.range(40).selectExpr("id", "id % 3 as k", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 9 as int)) as at", "rand(1) as v")
    plan = scan.known_before(rows, rows, ["k"], "at", "v")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_wide_holm_is_holm(spark):
    rows = [(i, "f" if i % 3 else "g", None if i % 11 == 0 else (i * 37 % 101) / 101) for i in range(250)] + [(300, "h", 0.01), (301, "h", 0.02), (302, "h", 0.03), (303, "h", 0.2)]
    df = spark.createDataFrame(rows, "id long, family string, p double")
    want = {r["id"]: r["p_holm"] for r in ledger.holm(df, ["family"], "p", ["id"]).collect()}
    got = {r["id"]: r["p_holm"] for r in ledger.holm_wide(df, ["family"], "p", ["id"]).collect()}
    assert got.keys() == want.keys() and all(got[i] == want[i] or math.isclose(got[i], want[i]) for i in want)
    assert [round(got[i], 9) for i in (300, 301, 302, 303)] == [0.04, 0.06, 0.06, 0.2]
