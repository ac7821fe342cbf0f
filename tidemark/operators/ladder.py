"""How far each condition has come: the last gate that it has cleared, and the first that it fails.

Everything up to ECONOMICALLY_SUPPORTED is judged on the cases before a boundary, and that set is written before a case
from the boundary on is read; only what it holds is looked at there, with what it was frozen with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.discovery import MIN_N, judged, moments
from tidemark.operators.ledger import t_interval, temporal_stability
from tidemark.shared import stored

# States in order, and the cost of a trade.
STATES = ("DISCOVERED", "STATISTICALLY_SUPPORTED", "INCREMENTAL", "SHADOW", "ECONOMICALLY_SUPPORTED", "TEST_VALIDATED")
COST = 0.001


def climbed(rows: DataFrame, gates: Sequence[tuple[str, Column, Column]], start: str = STATES[0]) -> DataFrame:
    """rows with reached_state, the state of the last gate passed in order, and rejection_reason, that of the first gate
    failed (null where none is). A null condition is a failed one."""
    state, reason, up = F.lit(start), F.lit(None).cast("string"), F.lit(True)
    for name, passed, why in gates:
        ok = F.coalesce(passed, F.lit(False))
        reason = F.when(up & ~ok, why).otherwise(reason)
        up = up & ok
        state = F.when(up, name).otherwise(state)
    return rows.withColumns({"reached_state": state, "rejection_reason": reason})


def economics(trades: DataFrame, keys: Sequence[str], net: str, prefix: str) -> DataFrame:
    """Per key: trades, their mean, the lower end of its 95 % interval and gains over losses (null without a loss)."""
    x = F.col(net)
    out = trades.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.sum(F.when(x > 0, x)).alias("won"), F.sum(F.when(x <= 0, -x)).alias("lost"))
    low = F.when(F.col("n") >= 2, F.col("mean") - t_interval(F.col("sd"), F.col("n")))
    return out.select(*keys, F.col("n").alias(f"{prefix}_n"), F.col("mean").alias(f"{prefix}_expectancy"), low.alias(f"{prefix}_low"), F.when(F.col("lost") > 0, F.coalesce("won", F.lit(0.0)) / F.nullif(F.col("lost"), F.lit(0.0))).alias(f"{prefix}_profit_factor"))


def _pays(prefix: str, factor: bool) -> Column:
    ok = (F.col(f"{prefix}_n") >= MIN_N) & (F.col(f"{prefix}_expectancy") > 0) & (F.col(f"{prefix}_low") > 0)
    return ok & (F.col(f"{prefix}_profit_factor").isNull() | (F.col(f"{prefix}_profit_factor") > 1)) if factor else ok


def validate_phase(cases: DataFrame, keys: Sequence[str], boundary: Column, baseline: float = 0.0, diagnostics: DataFrame | None = None, time_col: str = "published_at", key: str = "event_id", value: str = "realized", cost: float = COST) -> DataFrame:
    """One row per condition with cases before the boundary: its test, halves and economics there, side (of the baseline,
    which is that of its trades), reached_state and rejection_reason. diagnostics, where given, has incremental_status and
    permutation_status of conditions; without it those gates are not asked. Null outcomes don't count."""
    early = cases.where((F.col(time_col) < boundary) & F.col(value).isNotNull())
    tests = judged(early.groupBy(*keys).agg(*moments(value)), F.lit(baseline))
    halves = temporal_stability(early, keys, [time_col, key], value).select(*keys, "stable")
    rows = tests.join(halves, [*keys]).withColumn("side", F.signum(F.col("mean_effect") - baseline))
    trades = early.join(rows.where("side <> 0").select(*keys, "side"), [*keys]).withColumn("net", F.col("side") * F.col(value) - cost)
    rows = rows.join(economics(trades, keys, "net", "validate"), [*keys], "left")
    gates = [("STATISTICALLY_SUPPORTED", F.col("status") == "CONFIRMED", F.concat(F.lit("significance: "), "status"))]
    if diagnostics is not None:
        rows = rows.join(diagnostics.select(*keys, "incremental_status", "permutation_status"), [*keys], "left")
        told = lambda what, c: F.concat(F.lit(f"{what}: "), F.coalesce(c, F.lit("unavailable")))
        gates.append(("INCREMENTAL", F.col("incremental_status") == "INCREMENTAL_VALUE_CONFIRMED", told("incremental value", F.col("incremental_status"))))
        gates.append(("INCREMENTAL", F.col("permutation_status") == "SURVIVES_PERMUTATION", told("permutation", F.col("permutation_status"))))
    few = F.coalesce(F.col("validate_n"), F.lit(0)) < MIN_N
    gates.append(("SHADOW", F.col("stable"), F.lit("temporal stability")))
    gates.append(("ECONOMICALLY_SUPPORTED", _pays("validate", True), F.when(few, "too few trades before the boundary").otherwise("economics before the boundary")))
    return climbed(rows, gates)


def evidence_ladder(cases: DataFrame, keys: Sequence[str], boundary: Column, baseline: float = 0.0, diagnostics: DataFrame | None = None, time_col: str = "published_at", key: str = "event_id", value: str = "realized", cost: float = COST) -> DataFrame:
    """`validate_phase`, frozen, with the economics of what is ECONOMICALLY_SUPPORTED from the boundary on, and
    TEST_VALIDATED where they hold there too."""
    frozen = stored(validate_phase(cases, keys, boundary, baseline, diagnostics, time_col, key, value, cost), "frozen")
    held = frozen.where("reached_state = 'ECONOMICALLY_SUPPORTED'").select(*keys, "side")
    late = cases.where((F.col(time_col) >= boundary) & F.col(value).isNotNull()).join(held, [*keys]).withColumn("net", F.col("side") * F.col(value) - cost)
    rows = frozen.join(economics(late, keys, "net", "test"), [*keys], "left")
    pending = F.col("reached_state") == "ECONOMICALLY_SUPPORTED"
    few = F.coalesce(F.col("test_n"), F.lit(0)) < MIN_N
    passed = F.coalesce(_pays("test", False), F.lit(False))
    why = F.when(pending & ~passed, F.when(few, "too few trades from the boundary on").otherwise("economics from the boundary on")).otherwise(F.col("rejection_reason"))
    return rows.withColumns({"rejection_reason": why, "reached_state": F.when(pending & passed, "TEST_VALIDATED").otherwise(F.col("reached_state"))})


def state_counts(rows: DataFrame) -> DataFrame:
    """(reached_state, n) for every state, none included."""
    states = rows.sparkSession.createDataFrame([(s,) for s in STATES], "reached_state string")
    return states.join(rows.groupBy("reached_state").agg(F.count(F.lit(1)).alias("n")), "reached_state", "left").na.fill(0, ["n"])
