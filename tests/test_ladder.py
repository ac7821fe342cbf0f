"""The evidence ladder on planted conditions; what comes from the boundary on can't change what was frozen before it."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import ladder

DAY = dt.datetime(2020, 1, 1)
SCHEMA = "event_id string, condition string, published_at timestamp, realized double"


def boundary():
    return F.lit("2020-03-01").cast("timestamp")


def rows_of(name, before, after, n=40):
    at = lambda i, late: DAY + dt.timedelta(days=(90 if late else 0) + i)
    return [(f"{name}{late}{i}", name, at(i, late), f(i)) for late, f in ((0, before), (1, after)) for i in range(n) if f(i) is not None]


def steady(effect):
    return lambda i: effect + (0.01 if i % 2 else -0.01)


CASES = [
    *rows_of("good", steady(0.05), steady(0.05)), *rows_of("fades", steady(0.05), steady(-0.05)), *rows_of("short", steady(-0.05), steady(-0.05)),
    *rows_of("noise", steady(0.0), steady(0.05)), *rows_of("thin", lambda i: 0.05 if i < 5 else None, steady(0.05)),
    *rows_of("turns", lambda i: -0.002 * (i % 3) if i < 20 else 0.05 + 0.001 * (i % 2), steady(0.05)), *rows_of("quiet", steady(0.05), lambda i: 0.05 if i < 3 else None),
    *rows_of("empty", lambda i: None, steady(0.05)),
]


def test_states_and_reasons(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    got = {r["condition"]: (r["reached_state"], r["rejection_reason"]) for r in ladder.evidence_ladder(df, ["condition"], boundary()).collect()}
    assert got == {
        "good": ("TEST_VALIDATED", None), "short": ("TEST_VALIDATED", None), "fades": ("ECONOMICALLY_SUPPORTED", "economics from the boundary on"),
        "noise": ("DISCOVERED", "significance: REJECTED_ECONOMICALLY_TRIVIAL"), "thin": ("DISCOVERED", "significance: INSUFFICIENT_N"),
        "turns": ("STATISTICALLY_SUPPORTED", "temporal stability"), "quiet": ("ECONOMICALLY_SUPPORTED", "too few trades from the boundary on"),
    }
    more = spark.createDataFrame([("good", "INCREMENTAL_VALUE_CONFIRMED", "SURVIVES_PERMUTATION"), ("short", "INCREMENTAL_VALUE_CONFIRMED", "CONSISTENT_WITH_CHANCE"), ("fades", "NO_INCREMENTAL_VALUE", None)], "condition string, incremental_status string, permutation_status string")
    asked = {r["condition"]: (r["reached_state"], r["rejection_reason"]) for r in ladder.evidence_ladder(df, ["condition"], boundary(), diagnostics=more).collect()}
    assert asked["good"] == ("TEST_VALIDATED", None) and asked["short"] == ("INCREMENTAL", "permutation: CONSISTENT_WITH_CHANCE")
    assert asked["fades"] == ("STATISTICALLY_SUPPORTED", "incremental value: NO_INCREMENTAL_VALUE") and asked["quiet"][1] == "incremental value: unavailable"
    counts = {r["reached_state"]: r["n"] for r in ladder.state_counts(ladder.evidence_ladder(df, ["condition"], boundary())).collect()}
    assert counts == {"DISCOVERED": 2, "STATISTICALLY_SUPPORTED": 1, "INCREMENTAL": 0, "SHADOW": 0, "ECONOMICALLY_SUPPORTED": 2, "TEST_VALIDATED": 2}


def test_later_cases_change_nothing_before_the_boundary(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    other = df.withColumn("realized", F.when(F.col("published_at") >= boundary(), -7 * F.col("realized")).otherwise(F.col("realized")))
    columns = ["condition", "n", "mean_effect", "p", "side", "validate_n", "validate_low", "reached_state", "rejection_reason"]
    frozen = [sorted(map(str, ladder.validate_phase(x, ["condition"], boundary()).select(*columns).collect())) for x in (df, other, df.where(F.col("published_at") < boundary()))]
    assert frozen[0] == frozen[1] == frozen[2]
