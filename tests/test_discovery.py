"""The search for setups and by family, on planted effects."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import discovery as dis, ledger

DAY = dt.datetime(2016, 1, 1)
DIMS = {"regime": ("NORMAL",), "breakout_state": ("NONE",), "momentum_state": ("FLAT",)}
OBSERVED = "observation_id string, as_of timestamp, realized double, regime string, breakout_state string, momentum_state string"


def observed(spark, effect_in_all, n=400):
    rows = []
    for i in range(n):
        hot = i % 2 == 0
        effect = 0.08 if hot and (effect_in_all or i < n * 0.4) else 0.0
        rows.append((f"E{i:04d}", DAY + dt.timedelta(days=i), effect + (0.002 if i % 4 < 2 else -0.002), "NORMAL", "BREAKOUT_UP" if hot else "NONE", None))
    return spark.createDataFrame(rows, OBSERVED)


def test_lasting_signal_is_validated(spark):
    got = dis.setup_escalation(observed(spark, True), DIMS).collect()
    assert [(r["condition"], r["status"], r["cleared"]) for r in got] == [("breakout_state=BREAKOUT_UP", "TEST_VALIDATED", "TEST_VALIDATED")]
    r = got[0]
    assert (r["train_n"], r["validate_n"], r["shadow_n"], r["test_n"]) == (80, 60, 30, 30)
    assert r["train_baseline"] == pytest.approx(0.04) and r["invalidation_pct"] == pytest.approx(0.08)
    assert {r[f"{s}_status"] for s in ("train", "validate", "shadow", "test")} == {"CONFIRMED"}


def test_signal_in_train_alone_stops_at_validate(spark):
    r = dis.setup_escalation(observed(spark, False), DIMS).collect()[0]
    assert (r["status"], r["cleared"], r["train_status"]) == ("REJECTED", "TRAIN_SCREENED", "CONFIRMED")
    # The effect is significant there, on the other side of the baseline: a change of sign is no confirmation.
    assert r["validate_status"] == "CONFIRMED" and r["validate_effect"] < r["train_baseline"] < r["train_effect"]
    assert r["shadow_n"] is None and r["test_status"] is None


def test_budget_and_few_rows(spark):
    rows = observed(spark, True)
    assert dis.setup_escalation(rows, DIMS, budget=dis.SetupBudget(dimensions=1)).count() == 0
    assert dis.setup_escalation(rows.limit(0), DIMS).count() == 0 and dis.setup_escalation(rows.orderBy("as_of").limit(20), DIMS).count() == 0
    two = rows.withColumn("momentum_state", F.when(F.col("breakout_state") == "BREAKOUT_UP", "POSITIVE").otherwise("FLAT"))
    assert {r["arity"] for r in dis.setup_escalation(two, DIMS).collect()} == {1, 2}
    assert dis.setup_escalation(two, DIMS, budget=dis.SetupBudget(combinations=2)).count() == 2
    assert {r["field"]: r["cap"] for r in dis.recorded(rows, dis.SetupBudget()).collect()} == {"dimensions": 19, "per_combination": 2, "combinations": 40}


CASES = "event_id string, event_type string, direction string, horizon_days int, published_at timestamp, realized double, regime string, prior_return_bucket string, breakout_state string"


def case(i, effect, state="BREAKOUT_UP", kind="GUIDANCE", regime="RISK_ON"):
    return (f"E{i}", kind, "positive", 20, DAY + dt.timedelta(days=i), effect + (0.005 if i % 2 else -0.005), regime, None, state)


def test_only_what_a_level_confirms_is_looked_at_by_the_next(spark):
    rng = random.Random(1)
    rows = [case(i, 0.10) for i in range(30)] + [case(100 + i, 0.0, "NONE") for i in range(30)]
    rows += [case(i, 0.10, kind="FEW") for i in range(5)] + [case(i, rng.choice([-0.1, 0.1]), kind="NOISE") for i in range(40)]
    df = spark.createDataFrame(rows, CASES)
    got = dis.research_tree(df, {"breakout_state": ("NONE",)}, ["regime", "prior_return_bucket"], F.lit(0.02)).collect()
    by = {(r["event_type"], r["level"], r["value"], r["context"]): r for r in got}
    assert set(by) == {("GUIDANCE", 1, None, None), ("GUIDANCE", 2, "BREAKOUT_UP", None), ("GUIDANCE", 3, "BREAKOUT_UP", "regime"), ("FEW", 1, None, None), ("NOISE", 1, None, None)}
    assert by["GUIDANCE", 1, None, None]["n"] == 30 and by["GUIDANCE", 2, "BREAKOUT_UP", None]["n"] == 29  # not the last
    assert {r["status"] for k, r in by.items() if k[0] == "GUIDANCE"} == {"CONFIRMED"} and by["FEW", 1, None, None]["status"] == "REJECTED_INSUFFICIENT_N"
    assert by["GUIDANCE", 3, "BREAKOUT_UP", "regime"]["context_value"] == "RISK_ON"
    assert dis.research_tree(df.limit(0), {"breakout_state": ("NONE",)}, ["regime"], F.lit(0.0)).count() == 0


def test_interval(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(15)] + [("b", float(i % 3)) for i in range(100)] + [("c", 1.0)], "k string, v double")
    got = {r["k"]: r for r in ledger.one_sample_t(rows, ["k"], "v").collect()}
    # Quantiles of t with 14 and 99 degrees of freedom: 2.144787, 1.984217.
    assert got["a"]["ci_high"] - 7 == pytest.approx(2.144787 * 20**0.5 / 15**0.5, abs=1e-5)
    assert got["b"]["ci_high"] - got["b"]["mean_effect"] == pytest.approx(1.984217 * got["b"]["sd"] / 10, abs=1e-5)
    assert got["c"]["ci_low"] is None
