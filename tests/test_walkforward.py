"""The walk forward: segments, baselines of the burn-in alone, embargo, and governed learning against a replay case by case."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tidemark.operators import hypotheses as hyp, walkforward as walk

DAY = dt.datetime(2016, 1, 1)
CASES = "event_id string, event_type string, direction string, horizon_days int, published_at timestamp, realized double, may_learn boolean, regime string"


def student(t, df):
    """Two-sided p by Simpson's rule."""
    n, top = 4000, abs(t)
    f = lambda x: (1 + x * x / df) ** (-(df + 1) / 2)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = top / n
    area = h / 3 * (f(0) + f(top) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n)))
    return max(0.0, 1 - 2 * c * area)


def moments(xs):
    n, mean = len(xs), sum(xs) / len(xs)
    return n, mean, math.sqrt(sum((x - mean) ** 2 for x in xs) / (n - 1)) if n > 1 else None


def p_of(xs, base):
    n, mean, sd = moments(xs)
    return student((mean - base) / (sd / math.sqrt(n)), n - 1) if sd else (1.0 if mean == base else 0.0)


def holds(xs, base, least):
    return len(xs) >= least and abs(moments(xs)[1] - base) >= 0.003 and p_of(xs, base) < 0.05


def replay(cases, base, until=None):
    """Every quarter's state of every condition, looking at the cases one by one."""
    due = lambda c: c[4].date() + dt.timedelta(days=c[3] + 2)
    start = lambda d: dt.datetime(d.year, (d.month - 1) // 3 * 3 + 1, 1)
    after = lambda q: dt.datetime(q.year + (q.month == 10), (q.month + 3 - 1) % 12 + 1, 1)
    first, last = min(after(start(due(c))) for c in cases), max(after(start(due(c))) for c in cases)
    state, out, at = {}, {}, first
    while at <= last and not (until and at >= until):
        batch = {}
        for c in cases:
            if c[6] and after(start(due(c))) == at and c[7]:
                key = (*c[1:4], f"regime={c[7]}")
                if key not in batch or (c[4], c[0]) > (batch[key][4], batch[key][0]):
                    batch[key] = c
        tested = []
        for key, c in batch.items():
            xs = [o[5] for o in cases if (*o[1:4], f"regime={o[7]}") == key and o[4] < c[4]]
            tested.append((p_of(xs, base) if len(xs) >= 15 else None, key, xs))
        confirmed = {}
        for h in {k[2] for _, k, _ in tested}:
            family = sorted((t for t in tested if t[1][2] == h and t[0] is not None), key=lambda t: (t[0], batch[t[1]][0]))
            top = 0.0
            for i, (p, key, xs) in enumerate(family):
                top = max(top, (len(family) - i) * p)
                if abs(moments(xs)[1] - base) >= 0.003 and min(1.0, top) < 0.05:
                    confirmed[key] = xs
        for key, xs in confirmed.items():
            state[key] = ["SHADOW", moments(xs)[1], len(xs), state[key][3] if key in state else at]
        for key, s in state.items():
            mine = [c for c in cases if (*c[1:4], f"regime={c[7]}") == key and due(c) <= at.date()]
            new = [c[5] for c in mine if c[4].date() >= s[3].date()]
            if s[0] == "SHADOW" and len(new) >= 10:
                s[0] = "ACTIVE" if holds(new, base, 10) else "RETIRED"
            if s[0] == "ACTIVE":
                xs = [c[5] for c in mine]
                s[0] = "ACTIVE" if holds(xs, base, 15) else "RETIRED"
                if s[0] == "ACTIVE":
                    s[1:3] = moments(xs)[1], len(xs)
            out[at, key] = (s[0], round(s[1], 9), s[2])
        at = after(at)
    return out


def make_cases(seed=3):
    rng, rows = random.Random(seed), []
    for i in range(700):
        day = rng.randint(0, 900)
        regime = rng.choice(["RISK_ON", "RISK_OFF", "CALM", None])
        effect = {"RISK_ON": 0.05, "RISK_OFF": 0.05 if day < 300 else -0.05, "CALM": 0.0, None: 0.0}[regime]
        rows.append((f"E{i:04d}", rng.choice("AB"), "positive", rng.choice([5, 20]), DAY + dt.timedelta(days=day), effect + rng.gauss(0, 0.03), rng.random() < 0.4, regime))
    return rows


def test_governed_checkpoints_are_a_replay(spark):
    rows = make_cases()
    df = spark.createDataFrame(rows, CASES)
    values = hyp.known_values(["regime"])
    governed = walk.governed_checkpoints(df, values, F.lit(0.01), pool=1)
    got = {(r["checkpoint"], (r["event_type"], r["direction"], r["horizon_days"], r["condition"])): (r["status"], round(r["effect"], 9), r["n"]) for r in governed.collect()}
    assert got == replay(rows, 0.01)
    assert {s for s, _, _ in got.values()} == {"SHADOW", "ACTIVE", "RETIRED"}
    # Nothing is used before its promotion, and versions never fall.
    used = walk.active_at(governed, hyp.conditions(df, values, pool=1)).join(governed.where("status = 'ACTIVE'").groupBy(*walk.KEYS).agg(F.min("active_from").alias("first_active")), [*walk.KEYS])
    assert used.count() > 0 and used.where("published_at < first_active").count() == 0
    versions = [r["v"] for r in governed.groupBy("checkpoint").agg(F.max("version").alias("v")).orderBy("checkpoint").collect()]
    log = walk.governance_log(governed)
    assert versions == sorted(versions) and {r["action"] for r in log.collect()} == {"CREATE_RELATIONSHIP", "STRENGTHEN_RELATIONSHIP", "EVALUATE_SHADOW", "REVALIDATE_RELATIONSHIP"}
    frozen = walk.governed_checkpoints(df, values, F.lit(0.01), pool=1, freeze_from="2017-06-01")
    assert {(r["checkpoint"], r["condition"]) for r in frozen.collect()} == {(at, key[3]) for at, key in replay(rows, 0.01, dt.datetime(2017, 6, 1))}
    assert walk.governed_checkpoints(df.limit(0), values, F.lit(0.01), pool=1).count() == 0


def test_static_walk(spark):
    events = spark.createDataFrame([(f"e{i:03d}", "A", "up" if i % 2 else "down", DAY + dt.timedelta(days=i)) for i in range(103)], "event_id string, entity string, direction string, published_at timestamp")
    rows = walk.walk_segments(events.withColumn("direction", F.when(F.col("direction") == "up", "positive").otherwise("negative")))
    assert {r["segment"]: r["n"] for r in rows.groupBy("segment").agg(F.count("*").alias("n")).collect()} == {"BURN_IN": 20, "DEVELOPMENT": 63, "FINAL_HOLDOUT": 20}
    outcomes = rows.withColumns({"horizon_days": F.explode(F.array(F.lit(1), F.lit(60))), "outcome_status": F.lit("OK")})
    # Later outcomes must not reach the baseline.
    size = F.when(F.col("segment") == "BURN_IN", 0.04).otherwise(0.5)
    outcomes = outcomes.withColumn("realized", F.when(F.col("horizon_days") == 1, size * F.when(F.col("direction") == "positive", 1).otherwise(-1)).otherwise(F.when(F.col("segment") != "BURN_IN", 0.1)))
    outcomes = outcomes.withColumn("outcome_status", F.when(F.col("realized").isNull(), "INSUFFICIENT_DATA").otherwise("OK"))
    walked = walk.walkforward_static(outcomes).collect()
    assert len(walked) == 166 and {round(abs(r["predicted_impact"]), 9) for r in walked if r["horizon_days"] == 1} == {0.04}
    assert {abs(r["predicted_impact"]) for r in walked if r["horizon_days"] == 60} == {0.02}  # none known: the default
    assert all(r["resolve_at"] - r["published_at"] == dt.timedelta(days=r["horizon_days"] + 2) for r in walked)
    got = {(r["segment"], r["horizon_days"]): r for r in walk.scores(walk.walkforward_static(outcomes)).collect()}
    assert got["FINAL_HOLDOUT", 1]["direction_accuracy"] == 1.0 and got["DEVELOPMENT", 60]["n"] == 63


def test_ranks_of_predictions_that_vary_when_computed_anew(spark):
    varied = F.udf(lambda x: x * (1 + random.random() * 1e-9), "double").asNondeterministic()
    rows = spark.range(60).select(F.lit("STATIC").alias("agent"), F.lit("DEVELOPMENT").alias("segment"), F.lit(1).alias("horizon_days"), (F.col("id") / 100 - 0.3).alias("realized"), varied((F.col("id") + 1).cast("double")).alias("predicted_impact"))
    scored = walk.scores(rows.withColumns({"predicted_confidence": F.lit("MEDIUM"), "outcome_status": F.lit("OK")})).first()
    assert scored["n"] == 60 and abs(scored["spearman"] - 1) < 1e-9
