import math
"""The core operators on hand-made rows, and their queries against SQL on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import asof, ledger, technical, text
from tidemark.operators.graph import connected_components, merged_components
from tidemark.plans import market, news

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 1)


def bars(spark, closes, entity="A", volume=10.0):
    rows = [(entity, DAY + dt.timedelta(days=i), c, c * 1.001, c * 0.999, c, volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "entity string, ts timestamp, open double, high double, low double, close double, volume double")


def last_state(spark, closes):
    bench = bars(spark, [100.0] * len(closes), "ALL")
    return technical.technical_states(bars(spark, closes), bench).orderBy(F.col("ts").desc()).first()


def test_states_need_history(spark):
    short = last_state(spark, [100.0, 101.0])
    assert all(short[d] == "UNKNOWN" for d in technical.DEFAULT_VALUES if d not in ("gap_state", "price_action_pattern"))
    assert short["gap_state"] == "NO_GAP"


def test_states_of_a_rise(spark):
    row = last_state(spark, [100 * 1.01**i for i in range(60)])
    assert (row["trend_direction"], row["ma_slope_state"], row["momentum_state"], row["breakout_state"]) == ("UP", "RISING", "POSITIVE", "BREAKOUT_UP")
    assert (row["market_structure"], row["relative_strength_state"], row["ma_stack"]) == ("HIGHER_HIGHS_HIGHER_LOWS", "OUTPERFORMING", "UNKNOWN")


def test_spike_is_overextended(spark):
    assert last_state(spark, [100.0] * 24 + [150.0])["mean_reversion_state"] == "OVEREXTENDED_HIGH"


def test_asof_takes_the_last_known_close(spark):
    asked = spark.createDataFrame([(1, "A", DAY + dt.timedelta(hours=5)), (2, "A", DAY - dt.timedelta(days=1)), (3, "B", DAY), (4, None, DAY), (5, "A", None)], "k int, entity string, at timestamp")
    got = {r["k"]: r["price"] for r in asof.asof_close(asked, bars(spark, [10.0, 11.0]), "at").collect()}
    assert got == {1: 10.0, 2: None, 3: None, 4: None, 5: None}


def test_no_look_ahead(spark):
    events = spark.createDataFrame([(1, "A", DAY + dt.timedelta(days=2))], "event_id long, entity string, published_at timestamp")
    rows = asof.abnormal_returns(events, bars(spark, [10.0, 10.0, 10.0, 11.0, 999.0]), bars(spark, [5.0] * 5, "ALL"), (1,)).first()
    assert rows["realized"] == pytest.approx(0.1)


def test_student_p(spark):
    for df, t in ((1, 12.7062), (9, 2.26216), (10, 2.22814), (14, 2.14479)):
        p = spark.range(1).select(ledger.student_p(F.lit(t), F.lit(df)).alias("p")).first()["p"]
        assert p == pytest.approx(0.05, abs=1e-5)


def test_holm(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.20])] + [(9, None)], "i int, p double")
    got = [r["p_holm"] for r in ledger.holm(rows, [], "p", ["i"]).orderBy("i").collect()]
    assert got[:4] == pytest.approx([0.04, 0.06, 0.06, 0.20]) and got[4] is None


def test_drawdown(spark):
    rows = spark.createDataFrame([(0, i, 1.0, r, DAY + dt.timedelta(days=i)) for i, r in enumerate([0.05, 0.05, -0.06, -0.06, -0.06])], "g int, event_id int, predicted_impact double, realized double, published_at timestamp")
    assert ledger.portfolio_metrics(rows, ["g"], ["published_at"], cost=0.0).first()["max_drawdown"] == pytest.approx(-0.18)


def test_errors(spark):
    rows = spark.createDataFrame([(0.02, "MEDIUM", -0.03, "OK"), (0.02, "MEDIUM", 0.021, "OK"), (0.02, "MEDIUM", 0.2, "OK"), (None, "MEDIUM", 0.2, "OK"), (0.02, "MEDIUM", None, "INSUFFICIENT_DATA")], "predicted_impact double, predicted_confidence string, realized double, outcome_status string")
    assert [r["error_type"] for r in ledger.classify_error(rows).collect()] == ["WRONG_DIRECTION", "OK", "WRONG_MAGNITUDE", "INSUFFICIENT_DATA", "DATA_ERROR"]


def test_segments_are_exact(spark):
    rows = spark.range(101).select("id", F.lit(DAY).cast("timestamp").alias("at"))
    got = {r["segment"]: r["n"] for r in ledger.chrono_segments(rows, "at", "id").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"TRAIN": 40, "VALIDATE": 30, "SHADOW": 15, "TEST": 16}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 102), (101, 102), (7, 7), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 104)}, 200: 200}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_syndicated_titles_are_one_story(spark):
    rows = [(1, "Acme cuts guidance - Reuters", "TERTIARY", DAY), (2, "ACME cuts guidance | Yahoo Finance", "SECONDARY", DAY), (3, "Other", "TERTIARY", DAY)]
    docs = spark.createDataFrame(rows, "source_id int, title string, reliability string, published_at timestamp")
    assert {r["source_id"]: r["duplicate_of"] for r in text.dedupe_documents(docs).collect()} == {1: 2, 2: None, 3: None}


@pytest.mark.parametrize("name", ["technical_context", "abnormal_return", "trailing_returns", "holm", "top_values", "chrono_segments", "similar_cases", *news.QUERIES])
def test_oracle(spark, name):
    queries, sql = {**market.QUERIES, **news.QUERIES}, {**market.ORACLE_SQL, **news.ORACLE_SQL}
    got = queries[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = con.execute(sql[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def told(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "null"
        return f"{float(v):.5g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    rows = lambda d: sorted(tuple(map(told, r)) for r in d[cols].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_student_p_of_many_degrees(spark):
    """Both forms around their border, and far beyond it, against the density summed up finely."""
    def exact(t, df):
        n = 400_000
        top = 60.0
        xs = [t + (top - t) * (i + 0.5) / n for i in range(n)]
        c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
        return 2 * (top - t) / n * sum(math.exp(c - (df + 1) / 2 * math.log1p(x * x / df)) for x in xs)

    for t, df in ((0.5, 1000), (0.5, 1001), (2.5, 1001), (3.5, 5000), (1.96, 100_000)):
        p = spark.range(1).select(ledger.student_p(F.lit(t), F.lit(df)).alias("p")).first()["p"]
        assert p == pytest.approx(exact(t, df), rel=1e-6)
    far = spark.range(1).select(ledger.student_p(F.lit(1.959963984540054), F.lit(10**9)).alias("p")).first()["p"]
    assert far == pytest.approx(0.05, abs=1e-9)


def test_stories_without_titles_and_with_two_keys(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, None, "same body", "TERTIARY", day), (2, None, "same body", "SECONDARY", day), (3, None, "other", "TERTIARY", day), (4, "Title - Wire", "x", "TERTIARY", day), (5, "title", "y", "TERTIARY", day), (6, "Plan\t- Some Wire", "z", "TERTIARY", day), (7, "plan - some wire", "z", "TERTIARY", day), (8, "Plan", "q", "PRIMARY", day), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "source_id long, title string, body string, reliability string, published_at timestamp")
    got = {r["source_id"]: r["duplicate_of"] for r in text.dedupe_documents(docs).collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None, 5: 4, 6: 8, 7: 8, 8: None, 9: None}
    assert text.dedupe_documents(docs.limit(0)).count() == 0


def test_merged_components(spark):
    edge = lambda rows: spark.createDataFrame(rows, "src int, dst int")
    known = merged_components(None, edge([(1, 2), (4, 3), (8, 9)]))
    got = {r["node"]: r["component"] for r in merged_components(known, edge([(2, 4), (5, 9), (6, 7), (1, 2), (None, 3)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 8: 5, 9: 5, 6: 6, 7: 6}
    assert {r["node"] for r in merged_components(known, edge([])).collect()} == {1, 2, 3, 4, 8, 9}
