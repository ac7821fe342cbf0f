"""News state, assessment and strategy reports on hand-made rows, and their queries against SQL on the smallest tables."""

import datetime as dt
import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F
from tidemark.operators import assessment, identity, methodology, news_state as ns, strategy
from tidemark.plans import knowledge, state

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 1)
AREAS = {"revenue": ("revenue",), "demand": ("demand",), "workforce": ("layoffs",)}
EVENT = "entity string, event_type string, area string, clause string, sentiment string, evidence_type string, materiality string, reliability string, source_type string, source_id long, duplicate_of long, published_at timestamp"


def event(spark, *rows):
    full = [("A", "EARNINGS", "revenue", clause, mood, kind, "HIGH", "SECONDARY", "news", source, copy, DAY + dt.timedelta(days=day)) for clause, mood, kind, source, copy, day in rows]
    return spark.createDataFrame(full, EVENT)


def test_items_take_the_first_list_and_others_go(spark):
    rows = spark.createDataFrame([(1, "X raises full-year guidance"), (2, "X raises its dividend, cuts outlook"), (3, "X opens a plant"), (4, None), (5, "")], "k int, text string")
    assert {r["k"]: (r["event_type"], r["direction"]) for r in ns.interpret_items(rows).collect()} == {1: ("GUIDANCE_CHANGE", "positive"), 2: ("GUIDANCE_CHANGE", "negative")}


def test_roles(spark):
    rows = spark.createDataFrame([("Rival AMD posted gains",), ("Rival Acme posted gains",), ("curbs hurt the broader industry",), ("Acme: curbs hurt the broader industry",), ("customers wait",), ("its subsidiary grew",), ("sales grew",), (None,)], "clause string")
    got = rows.select(ns.attribution(F.col("clause"), F.lit("ACM"), F.array(F.lit("Acme"), F.lit(None).cast("string"))).alias("x")).select("x.*").collect()
    assert [r["role"] for r in got][1:7] == ["SELF", "INDUSTRY", "SELF", "COUNTERPARTY", "SUBSIDIARY", "SELF"]
    assert not got[2]["attributable"] and got[7]["role"] == "SELF"


def test_aliases(spark):
    rows = spark.createDataFrame([("Acme Corp",), ("Acme",), (None,), ("",)], "name string")
    assert [r[0] for r in rows.select(ns.name_aliases(F.col("name"))).collect()] == [["Acme Corp", "Acme"], ["Acme"], [], []]


def test_implications_and_axes(spark):
    rows = event(spark, ("revenue grew 30 percent", "POSITIVE", "FACT", 1, None, 0), ("revenue fell", "NEGATIVE", "SPECULATION", 2, 1, 0), ("layoffs to cut costs", "NEGATIVE", "REPORTING", 3, None, 0), ("nothing", "NEUTRAL", "FACT", 4, None, 9))
    clustered = identity.event_instances(rows, tie="source_id")
    axes = {r["axis"]: (r["mean"], r["dispersion"], r["basis"]) for r in ns.event_axes(ns.implications(clustered, AREAS)).collect()}
    mean = (1.0 - 0.5 * 0.4) / 1.4
    spread = (1.0 * (1 - mean) ** 2 + 0.4 * (-0.5 - mean) ** 2) / 1.4
    assert axes["growth"] == (round(mean, 2), round(spread, 4), "STATED")
    assert axes["risk"] == (0.5, 0.0, "INFERRED") and axes["profitability"] == (1.0, 0.0, "INFERRED")
    vectors = {r["cluster"]: r for r in ns.event_vectors(clustered, AREAS).collect()}
    assert sorted(vectors) == [1, 2]
    assert vectors[1]["independent_sources"] == 2 and vectors[1]["magnitude_confidence"] == round((0.85 + 0.4 + 0.4) / 3, 4)
    assert vectors[2]["text_sentiment"] is None and vectors[2]["magnitude_confidence"] == 0.0


def test_no_events(spark):
    none = identity.event_instances(event(spark).limit(0), tie="source_id")
    vectors, axes = ns.event_vectors(none, AREAS), ns.event_axes(ns.implications(none, AREAS))
    assert ns.company_state(vectors, F.lit(DAY)).count() == 0 and ns.company_axes(vectors, axes, F.lit(DAY)).count() == 0
    assert ns.novelty(ns.profiles(vectors, axes)).count() == 0


def test_novelty_needs_three_before(spark):
    rows = event(spark, *[("revenue grew", "POSITIVE", "FACT", i, None, 10 * i) for i in range(4)], ("revenue fell", "NEGATIVE", "FACT", 9, None, 50))
    clustered = identity.event_instances(rows, tie="source_id")
    got = {r["cluster"]: (r["priors"], r["novelty"]) for r in ns.novelty(ns.profiles(ns.event_vectors(clustered, AREAS), ns.event_axes(ns.implications(clustered, AREAS)))).collect()}
    assert got == {1: (0, None), 2: (1, None), 3: (2, None), 4: (3, 0.0), 5: (4, 1.0)}


def test_trajectory(spark):
    rows = spark.createDataFrame([("A", DAY, "growth", 0.5), ("A", DAY, "risk", 0.1), ("A", DAY + dt.timedelta(days=2), "growth", 0.1), ("B", DAY, "risk", 0.0)], "entity string, as_of timestamp, axis string, mean double")
    got = ns.trajectory(rows).collect()
    assert [(r["changed"], r["magnitude"], r["velocity"], r["heading"][0]) for r in got] == [(1, pytest.approx(0.4), 0.2, -1.0)]


def test_assessment(spark):
    told = spark.createDataFrame([("A", "E", "revenue", "POSITIVE", "HIGH", 3, "STABLE", None, None, False), ("A", "E", None, "NEGATIVE", "LOW", 1, "EMERGING", "x", "y", True)], "entity string, event_type string, area string, sentiment string, confidence string, independent_sources long, trend string, side_a string, side_b string, speculative boolean")
    direction = spark.createDataFrame([("A", "POSITIVE")], "entity string, direction string")
    figures = spark.createDataFrame([("A", "LongTermDebt", 40.0), ("A", "CashAndCashEquivalents", 10.0), ("B", "FreeCashFlow", -1.0)], "entity string, concept string, val double")
    checked = assessment.consistency(told, direction)
    assert sorted(r["verdict"] for r in checked.collect()) == ["INSUFFICIENT_EVIDENCE", "SUPPORTED"]
    risks = assessment.risks(told, figures)
    assert sorted((r["entity"], r["origin"], r["status"], r["severity"]) for r in risks.collect()) == [("A", "CONTRADICTION", "EMERGING", "MEDIUM"), ("A", "FIGURES", "KNOWN", "MEDIUM"), ("A", "NARRATIVE", "SPECULATIVE", "LOW"), ("B", "FIGURES", "KNOWN", "HIGH")]
    got = {r["entity"]: (r["score"], r["assessment"], r["confidence"]) for r in assessment.assess(checked, risks).collect()}
    assert got == {"A": (1.0, "NEUTRAL", 0.53), "B": (-2.0, "NEUTRAL", None)}
    news = spark.createDataFrame([("A", 1.0, 0.8), ("C", None, 0.1)], "entity string, news double, news_confidence double")
    modes = {(r["entity"], r["mode"]): (r["decision"], r["predicted_impact"], r["confidence_bucket"]) for r in assessment.modes(assessment.assess(checked, risks), news).collect()}
    assert modes["A", "B"] == ("CAUTIOUSLY_FAVORABLE", 0.5, "MEDIUM") and modes["A", "C"] == ("NEWS_ONLY_UP", 1.0, "HIGH")
    assert modes["C", "A"] == ("INSUFFICIENT_EVIDENCE", None, "LOW") and modes["C", "C"][0] == "NEWS_NO_SIGNAL"


def test_strategy_report(spark):
    rows = spark.createDataFrame([("a", 0.021, 0.03, -0.01), ("a", -0.009, 0.01, -0.02), ("a", 0.001, 0.0, 0.0), ("b", 0.1, 0.1, 0.0)], "k string, realized_return double, mfe double, mae double")
    (got,) = strategy.strategy_report(rows, ["k"]).collect()
    assert (got["k"], got["n_trades"], got["win_rate"]) == ("a", 3, pytest.approx(1 / 3))
    assert got["profit_factor"] == pytest.approx(2.0) and got["expectancy"] == pytest.approx(0.01 / 3)


@pytest.mark.parametrize("name", ["event_axes", "nearest_prior", "research_modes", "change_diff", "governance_apply", "predict_for_security", "placebo_pool", "family_screen", "concept_tagging", "concept_links", "methodologies_for_concept", "concept_coverage"])
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    tidy = lambda rows: sorted(repr(tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r)) for r in rows)
    assert tidy(tuple(r[c] for c in cols) for r in df.collect()) == tidy(want)
    assert name in state.QUERIES or name in knowledge.QUERIES


def test_concepts_of_methodologies(spark):
    texts = ["Buy breakouts above resistance on heavy volume, with a stop-loss.", "A 20/50/200 stack in stage 2; VWAP matters.", "He clears the prior high: gap up!", "Unsupported momentums of orbits.", "", None, "Risk one percent; weekly confirmation, news driven. Momentum."]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[0]])], "source_id int, body string, concept string")
    want = []
    for i, t in enumerate([*texts, texts[0]]):
        claims = [(i, c, found[0]) for c, ps in methodology.CONCEPT_PHRASES.items() if (found := [p for p in ps if re.search(rf"\b{p}\b", (t or "").lower())])]
        want += claims or [(i, None, None)]
    claims = methodology.concept_claims(docs)
    assert sorted(map(repr, (tuple(r) for r in claims.select("source_id", "concept", "phrase").collect()))) == sorted(map(repr, want))
    links = methodology.concept_links(claims)
    assert {r[0] for r in methodology.methodologies_for_concept(docs.drop("concept"), links, "BREAKOUT").select("source_id").collect()} == {0, 2, 7}
    assert len(methodology.CONCEPT_PHRASES) == 20 and methodology.concept_claims(docs.limit(0)).count() == 0
