"""Prices are looked up once per time of an entity, and real events are told apart before their outcomes are made."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import asof, ledger
from tidemark.plans import market

DAY = dt.datetime(2024, 3, 8)


def test_equal_times_are_asked_once(spark, monkeypatch):
    """Sixty events of one entity on two days, at three offsets: six look-ups, and two of the market's days at three."""
    events = spark.createDataFrame([(i, "A", DAY + dt.timedelta(days=i % 2)) for i in range(60)], "event_id long, entity string, published_at timestamp")
    bars = spark.createDataFrame([(e, DAY + dt.timedelta(days=i), 10.0 + i) for e in ("A", "ALL") for i in range(12)], "entity string, ts timestamp, close double")
    asked, plain = [], asof.asof_close
    monkeypatch.setattr(asof, "asof_close", lambda requests, *rest: asked.append(requests.count()) or plain(requests, *rest))
    rows = asof.abnormal_returns(events, bars.where("entity = 'A'"), bars.where("entity = 'ALL'"), (1, 5)).collect()
    assert asked == [6, 6]
    assert len(rows) == 120 and {r.realized for r in rows} == {0.0}


def test_last_close_is_carried_over_days(spark):
    """Bars and requests at any hour, days without bars, closes that are null: as found by search."""
    draw = random.Random(3)
    at = lambda: DAY + dt.timedelta(hours=draw.randrange(24 * 20))
    known = {(e, at()): draw.choice([None, draw.random()]) for e in "AB" for _ in range(25)}
    asked = [(i, draw.choice("ABC"), at()) for i in range(200)]
    bars = spark.createDataFrame([(e, t, c) for (e, t), c in known.items()], "entity string, ts timestamp, close double")
    got = {r.id: r.price for r in asof.asof_close(spark.createDataFrame(asked, "id int, entity string, at timestamp"), bars, "at").collect()}
    for i, e, t in asked:
        seen = [(ts, c) for (x, ts), c in known.items() if x == e and ts <= t and c is not None]
        assert got[i] == (max(seen)[1] if seen else None)


def test_real_events_before_outcomes(spark):
    """What is picked among events is what would be picked among their rows at all horizons; nulls are equal."""
    draw = random.Random(5)
    events = [(i, draw.choice(["A", None]), draw.choice(["t", "u"]), draw.choice(["up", None]), DAY + dt.timedelta(days=draw.randrange(3))) for i in range(80)]
    events = spark.createDataFrame(events + events[:10], "event_id long, entity string, event_type string, direction string, published_at timestamp")
    each = events.withColumn("horizon_days", F.explode(F.array(F.lit(1), F.lit(5))))
    keys = ["event_id", "entity", "event_type", "direction", "published_at"]
    want = sorted(map(str, each.groupBy(*ledger.REAL_EVENT).agg(F.min("event_id").alias("event_id")).where("horizon_days = 5").select(*keys).collect()))
    assert sorted(map(str, market.real_events(events).select(*keys).collect())) == want
    assert sorted(map(str, ledger.dedupe_real_event(each).where("horizon_days = 5").select(*keys).collect())) == want


def test_lines_are_aggregated_once(spark):
    """The cases read bars and benchmark that are written; lines were read again for the baseline, outcomes and contexts."""
    cases = market.full_ledger(spark, "/root/testdata/sf0.001")
    assert not [f for f in cases.inputFiles() if "lineitem" in f]


def test_prices_are_made_after_lines_met_parts(spark):
    plan = views.bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner")
    assert "AS price" in above and "AS price" not in below
