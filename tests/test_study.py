"""Conditions, trades, magnitudes, figures, sources and streams on small rows worked out by hand."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import fundamentals as fun, hypotheses as hyp, research, strategy
from tidemark.plans import study
from tidemark.sources import filings
from tidemark.streaming import items

DAY = dt.datetime(2024, 3, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_conditions_are_all_sets_of_known_values(spark):
    rows = spark.createDataFrame([(1, "RISK_ON", "UNKNOWN", None, "UP", "NONE")], "id int, regime string, prior_return_bucket string, vol_bucket string, trend string, gap string")
    values = hyp.known_values(hyp.CONTEXT, ("trend", "gap"), {"gap": ("NONE",)})
    got = {(r.condition, r.n_keys) for r in hyp.conditions(rows, values, empty=True).collect()}
    assert got == {("", 0), ("regime=RISK_ON", 1), ("trend=UP", 1), ("regime=RISK_ON&trend=UP", 2)}
    six = spark.createDataFrame([("a",) * 6], "a string, b string, c string, d string, e string, f string")
    assert hyp.conditions(six, hyp.known_values(tuple("abcdef"))).count() == 41


def test_prior_statistics_leave_out_the_same_time(spark):
    rows = spark.createDataFrame([("k", day(0), 1.0), ("k", day(1), 3.0), ("k", day(1), 5.0), ("k", day(2), 9.0)], "condition string, published_at timestamp, realized double")
    got = sorted((r.realized, r.prior_n, r.prior_mean) for r in hyp.prior_statistics(rows, ["condition"]).collect())
    assert got == [(1.0, 0, None), (3.0, 1, 1.0), (5.0, 1, 1.0), (9.0, 3, 3.0)]


def test_last_errors_are_those_of_each_case(spark, monkeypatch):
    """What is picked and known is as from the statistics of every listed case; conditions are made once a context."""
    draw = random.Random(11)
    rows = [(i, "A", "t", draw.choice(["up", None]), 5, day(draw.randrange(200)), draw.random() - 0.5, draw.random() < 0.3, *(draw.choice(["a", "b", None]) for _ in hyp.CONTEXT)) for i in range(300)]
    cases = spark.createDataFrame(rows, "event_id int, entity string, event_type string, direction string, horizon_days int, published_at timestamp, realized double, may_learn boolean, regime string, prior_return_bucket string, vol_bucket string").cache()
    keys = [*hyp.GROUP, "condition"]
    quarter = F.date_trunc("quarter", "published_at")
    plain = hyp.prior_statistics(hyp.conditions(cases, hyp.known_values(hyp.CONTEXT), pool=3)).where("may_learn")
    latest = Window.partitionBy(*keys, quarter).orderBy(F.col("published_at").desc(), F.col("event_id").desc())
    plain = plain.withColumn("k", F.row_number().over(latest)).where("k = 1").drop("k")
    want = {(r.event_id, r.condition): r for r in plain.collect()}
    listed, make = [], hyp.conditions
    monkeypatch.setattr(hyp, "conditions", lambda rows, *rest, **more: listed.append(rows.count()) or make(rows, *rest, **more))
    got = {(r.event_id, r.condition): r for r in study.checkpoints(cases).collect()}
    assert got.keys() == want.keys() and max(listed) <= 27
    for k, r in want.items():
        assert {c: got[k][c] for c in (*keys, "entity", "n_keys", "published_at", "prior_n")} == {c: r[c] for c in (*keys, "entity", "n_keys", "published_at", "prior_n")}
        assert (got[k].prior_mean, got[k].prior_sd) == (pytest.approx(r.prior_mean, abs=1e-9), pytest.approx(r.prior_sd, abs=1e-9))
    assert study.checkpoints(cases.limit(0)).count() == 0


def test_most_keys_then_support_win(spark):
    cases = spark.createDataFrame([(1, 5, 0.02, "MEDIUM"), (2, 5, 0.02, "MEDIUM")], "event_id int, horizon_days int, predicted_impact double, predicted_confidence string")
    found = spark.createDataFrame([(1, 5, "a", 1, 0.5, 90), (1, 5, "a&b", 2, 0.1, 60), (1, 5, "a&c", 2, 0.2, 20)], "event_id int, horizon_days int, condition string, n_keys int, effect_estimate double, n_supporting int")
    got = {r.event_id: (r.predicted_impact, r.predicted_confidence, r.basis) for r in hyp.adaptive_predict(cases, found).collect()}
    assert got == {1: (0.1, "HIGH", "validated_relationship"), 2: (0.02, "MEDIUM", "unconditional_baseline")}


def test_relationships_are_broadcast_not_cases(spark):
    """Also where Spark takes the cases for the smaller table."""
    listed = spark.range(9).selectExpr("id as event_id", "timestamp'2024-03-01' as published_at", "'a' as event_type", "'up' as direction", "5 as horizon_days", "if(id < 4, 'x=1', 'y=1') as condition", "1 as n_keys")
    known = spark.createDataFrame([("a", "up", 5, "x=1", 1, 0.1, dt.datetime(2024, 1, 1))], "event_type string, direction string, horizon_days int, condition string, n_keys int, effect_estimate double, active_from timestamp")
    found = hyp.applicable(listed, known)
    assert sorted(r.event_id for r in found.collect()) == [0, 1, 2, 3]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


@pytest.mark.parametrize("action,realized,mfe,mae", [("LONG", -0.05, 0.15, -0.10), ("SHORT", 0.05, 0.10, -0.15)])
def test_trade_outcome(spark, action, realized, mfe, mae):
    bars = spark.createDataFrame([("E", day(i), *p) for i, p in enumerate([(100.0, 101.0, 99.0, 100.0), (100.0, 115.0, 100.0, 110.0), (110.0, 111.0, 90.0, 95.0)])], "entity string, ts timestamp, open double, high double, low double, close double")
    trades = spark.createDataFrame([(1, 59, "E", day(0), action, -0.08)], "event_id int, horizon_days int, entity string, published_at timestamp, action string, invalidation_level double")
    row = strategy.trade_outcomes(strategy.trade_paths(trades, bars, ["event_id"]), ["event_id"]).first()
    assert (row.realized_return, row.mfe, row.mae) == pytest.approx((realized, mfe, mae))
    assert row.invalidation_day == (2 if action == "LONG" else 1) and row.holding_days == 2
    assert strategy.trade_outcomes(strategy.trade_paths(trades, bars.limit(1), ["event_id"]), ["event_id"]).count() == 0


def test_decisions(spark):
    rows = spark.createDataFrame([("REJECTED", 0.1, 0.05, 0.15), ("CONFIRMED", 0.1, -0.05, 0.25), ("CONFIRMED", 0.001, 0.0005, 0.0015), ("CONFIRMED", -0.1, -0.2, -0.05)], "status string, e double, low double, high double")
    got = {(r.action, r.abstain_reason) for r in strategy.decide(rows, "e", "low", "high").collect()}
    assert got == {("ABSTAIN", "HYPOTHESIS_ONLY"), ("ABSTAIN", "CI_SPANS_ZERO"), ("ABSTAIN", "BELOW_COST_MARGIN"), ("SHORT", None)}


def test_bootstrap_and_permutation(spark):
    rows = spark.createDataFrame([("g", i, float(i % 2), i < 20) for i in range(40)], "g string, id int, x double, picked boolean")
    one = strategy.bootstrap_interval(strategy.bootstrap_means(rows, ["g"], "x", ["id"], 100), ["g"]).first()
    assert one.ci_low < 0.5 < one.ci_high and one.replicates == 100
    assert strategy.permutation_p(rows, ["g"], "x", "picked", "id", 50).first().p == 1.0
    far = rows.withColumn("x", F.col("picked").cast("double"))
    assert strategy.permutation_p(far, ["g"], "x", "picked", "id", 50).first().p == 0.0


@pytest.mark.parametrize("said,want", [("up 5% or 80 bps", ("PERCENT", 5.0, 0.3)), ("fell -10 percent", ("PERCENT", -10.0, 0.45)), ("100 basis points", ("BPS", 100.0, 0.45)), ("paid $2 billion", ("USD", 2e9, None)), ("90%", ("PERCENT", 90.0, 1.0)), ("nothing", None), (None, None)])
def test_magnitude(spark, said, want):
    found = spark.createDataFrame([(said,)], "t string").select(research.magnitude(F.col("t")).alias("m")).first().m
    assert (found and tuple(found)) == want


def test_series_growth_and_direction(spark):
    d = dt.date
    rows = [("E", "Old", d(2020, 1, 1), d(2020, 3, 31), 1.0, "10-Q", d(2020, 5, 1)), ("E", "Sales", d(2023, 1, 1), d(2023, 3, 31), 100.0, "10-Q", d(2023, 5, 1)), ("E", "Sales", d(2023, 1, 1), d(2023, 3, 31), 80.0, "10-Q", d(2023, 8, 1)), ("E", "Sales", d(2024, 1, 1), d(2024, 3, 31), 120.0, "10-Q", d(2024, 5, 1)), ("E", "Sales", d(2024, 1, 1), d(2024, 6, 30), 999.0, "10-Q", d(2024, 8, 1)), ("E", "Sales", d(2024, 4, 1), d(2024, 6, 30), 999.0, "8-K", d(2024, 8, 1))]
    found = fun.series(spark.createDataFrame(rows, "entity string, tag string, start date, end date, val double, form string, filed date"), {"Revenues": ("Old", "Sales")})
    assert sorted(r.val for r in found.collect()) == [80.0, 120.0]
    growth = fun.yoy_growth(found)
    assert growth.first().growth == pytest.approx(0.5)
    assert fun.direction(growth).first().direction == "POSITIVE"


def test_filing_hits_and_index(spark):
    hits = [("1", ["Acme (ACME)"], "2024-03-01", ["2.02"], "positive", "late"), ("1", ["Acme (ACME)"], "2024-03-01", ["2.02"], "positive", "early"), ("2", ["Nobody"], "2024-03-01", None, "positive", "early")]
    row, = filings.filing_hits(spark.createDataFrame(hits, filings.HIT), ["early", "late"]).collect()
    assert (row.entity, row.matched_phrase, row.published_at) == ("ACME", "early", DAY)
    index = [("A", "Acme", (["10-K", "4", "8-K", "10-Q"], ["2024-02-01", "2024-02-01", "2024-01-01", "2020-01-01"], list("abcd"), list("wxyz"), ["", "", "5.02", ""]))]
    got = filings.filings_index(spark.createDataFrame(index, filings.INDEX), "2024-03-01").collect()
    assert [(r.source_id, r.item_codes) for r in got] == [("sec:a", None), ("sec:c", "5.02")]


def test_news_documents_and_facts(spark, tmp_path):
    rows = [("T", "u", "<a href='x'>Hello</a>   there", " Reuters ", DAY, "E"), ("T2", None, None, None, DAY, "E"), ("  ", "u", "b", "p", DAY, "E")]
    got = filings.news_documents(spark.createDataFrame(rows, "title string, link string, description string, publisher string, published_at timestamp, entity string")).collect()
    assert [(r.body, r.reliability) for r in got] == [("Hello there", "SECONDARY"), ("T2", "TERTIARY")]
    nested = [("E", {"us-gaap": {"Sales": ({"USD": [("2024-01-01", "2024-03-31", 5.0, "10-Q", "Q1", "2024-05-01")]},)}})]
    row, = filings.company_facts(spark.createDataFrame(nested, filings.FACTS)).collect()
    assert (row.tag, row.unit, row.val, row.end) == ("Sales", "USD", 5.0, dt.date(2024, 3, 31))
    (tmp_path / "w.txt").write_text("# none\nacme # ours\n\n spy\n")
    assert sorted(r.ticker for r in filings.watchlist(spark, str(tmp_path / "w.txt")).collect()) == ["ACME", "SPY"]


def test_growing_tables(spark):
    old, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "id int, v string")
    assert [tuple(r) for r in filings.insert_if_absent(new, old, ["id"]).collect()] == [(2, "c")]
    assert filings.rejected_outcomes(new, old, ["id"]).count() == 1
    log = spark.createDataFrame([(1, 1, "SHADOW", "breakout"), (1, 2, "ACTIVE", None)], "id int, at int, status string, concept string")
    row, = filings.latest_state(log, ["id"], ["at"], ["concept"]).collect()
    assert (row.status, row.concept) == ("ACTIVE", "breakout")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "E", DAY, 1.0), ("a", "E", DAY, 1.0), ("b", "E", day(0.25), 4.0), ("c", "F", day(1), None)], "id string, entity string, published_at timestamp, score double")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def ran(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "state" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.id for r in ran(items.deduped_items(source, ["id"]), "items")) == ["a", "b", "c"]
    state = {r.entity: (r["mean"], r.n_events) for r in ran(items.windowed_state(source, "score", F.lit(2.0)), "state")}
    assert state == {"E": (2.0, 3), "F": (None, 1)}
    for i in range(2):
        items.resolving(source, str(tmp_path / "out"), ["id"], lambda b: b.select("id", F.lit("OK").alias("outcome")), str(tmp_path / f"ck{i}")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_bootstrap_against_numpy(spark):
    """Skewed values, two groups: the interval of 2000 resamples is that of numpy's resamples, within their own noise."""
    rng = np.random.default_rng(1)
    values = {"a": rng.exponential(1.0, 300), "b": rng.normal(-2, 3, 800)}
    rows = spark.createDataFrame([(g, i, float(x)) for g, v in values.items() for i, x in enumerate(v)], "g string, id long, x double")
    got = {r.g: r for r in strategy.bootstrap_interval(strategy.bootstrap_means(rows, ["g"], "x", ["id"]), ["g"]).collect()}
    for g, v in values.items():
        means = rng.choice(v, (4000, len(v))).mean(1)
        assert got[g].replicates == 2000
        for have, want in ((got[g].ci_low, np.quantile(means, 0.025)), (got[g].ci_high, np.quantile(means, 0.975))):
            assert abs(have - want) < 0.25 * means.std()


def test_permutation_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 400)
    picked = np.arange(400) < 60
    x[picked] += 0.2
    rows = spark.createDataFrame([("g", i, float(a), bool(b)) for i, (a, b) in enumerate(zip(x, picked))], "g string, id long, x double, picked boolean")
    one = strategy.permutation_p(rows, ["g"], "x", "picked", "id").first()
    draws = np.array([rng.choice(x, 60, replace=False).mean() for _ in range(6000)])
    want = (np.abs(draws - x.mean()) >= abs(x[picked].mean() - x.mean())).mean()
    assert one.n == 60 and abs(one.p - want) < 5 * np.sqrt(want * (1 - want) / 2000) + 0.005


def test_shadow_evaluation(spark):
    def cases(condition, n, day, value):
        return [("t", "up", 5, condition, dt.datetime(2024, 3, day), value + 0.0001 * (i % 3)) for i in range(n)]

    rows = cases("few", 9, 10, 0.02) + cases("some", 12, 10, 0.02) + cases("holds", 20, 1, 0.02) + cases("turned", 20, 10, 0.0) + cases("old", 30, 1, 0.02) + cases("late", 30, 20, 0.02)
    listed = spark.createDataFrame(rows, "event_type string, direction string, horizon_days int, condition string, published_at timestamp, realized double")
    start = {"few": 1, "some": 1, "holds": 1, "turned": 1, "old": 2, "late": 1, "none": 1}
    known = spark.createDataFrame([("t", "up", 5, c, dt.datetime(2024, 3, d)) for c, d in start.items()], "event_type string, direction string, horizon_days int, condition string, active_from timestamp")
    got = {r["condition"]: (r["n"], r["outcome"]) for r in hyp.shadow_evaluation(listed, known, F.lit(0.0), F.lit("2024-03-20").cast("timestamp")).collect()}
    wait = (0, "STILL_IN_SHADOW")
    assert got == {"few": (9, "STILL_IN_SHADOW"), "some": (12, "RETIRED"), "holds": (20, "ACTIVE"), "turned": (20, "RETIRED"), "old": wait, "late": wait, "none": wait}
