"""Walking forward through the events: predictions scored out of sample, and knowledge that is governed at checkpoints.

The batch walk is one plan: burn-in events give the baselines and are scored by nobody. The learning walk is a loop over
the quarters of the calendar, the only loop; each turn is one job over sums by condition and day, whose result is written,
and later quarters read only what was written before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators import hypotheses as hyp, ledger as led
from tidemark.operators.discovery import MIN_EFFECT, MIN_N, moments
from tidemark.shared import stored, work_dir

# Days between an outcome and its use, share of events for baselines and for the end, cases on probation.
EMBARGO_DAYS, BURN_IN, HOLDOUT = 2, 0.20, 0.20
MIN_SHADOW = 10
DEFAULT_BASELINE = 0.02
KEYS = (*hyp.GROUP, "condition")


def walk_segments(events: DataFrame, time_col: str = "published_at", key: str = "event_id") -> DataFrame:
    """events with segment: BURN_IN, DEVELOPMENT or FINAL_HOLDOUT by place in time, whole numbers of events."""
    rows = led.chrono_rank(events, time_col, key)
    segment = F.when(F.col("rn") <= F.floor(F.col("total") * BURN_IN), "BURN_IN").when(F.col("rn") > F.col("total") - F.floor(F.col("total") * HOLDOUT), "FINAL_HOLDOUT").otherwise("DEVELOPMENT")
    return rows.withColumn("segment", segment).drop("rn", "total")


def walkforward_static(outcomes: DataFrame, embargo: int = EMBARGO_DAYS) -> DataFrame:
    """outcomes (events with segment, horizon_days, realized and outcome_status) of all but the burn-in, with the static
    agent's prediction, when it is resolved, and error class. Baselines are the mean sizes of burn-in outcomes by horizon;
    horizons without any take the default."""
    every = outcomes.select("horizon_days").distinct()
    burnt = led.outcome_known(outcomes.where("segment = 'BURN_IN'")).groupBy("horizon_days").agg(F.avg(F.abs("realized")).alias("__b"))
    baselines = every.join(burnt, "horizon_days", "left").select("horizon_days", F.coalesce("__b", F.lit(DEFAULT_BASELINE)).alias("baseline"))
    rows = led.static_predict(outcomes.where("segment <> 'BURN_IN'"), baselines)
    resolved = F.col("published_at") + F.make_interval(days=F.col("horizon_days") + embargo)
    return led.classify_error(rows.withColumns({"agent": F.lit("STATIC"), "resolve_at": resolved}))


def burn_in_baseline(outcomes: DataFrame) -> Column:
    """The signed baseline of a case as an expression of its direction and horizon: one number for each horizon."""
    known = led.outcome_known(outcomes.where("segment = 'BURN_IN'")).groupBy("horizon_days").agg(F.avg(F.abs("realized")).alias("b")).collect()
    size = F.lit(DEFAULT_BASELINE)
    for r in known:
        size = F.when(F.col("horizon_days") == r["horizon_days"], F.lit(r["b"])).otherwise(size)
    return F.when(F.col("direction") == "positive", size).when(F.col("direction") == "negative", -size).otherwise(0.0)


def _holds(n: str, s: str, q: str, baseline: Column, least: int) -> Column:
    """Whether the mean of so many values differs from the baseline, by size and by test: the baseline lies outside the
    95 % interval, which is p below 0.05."""
    count = F.nullif(F.col(n), F.lit(0))
    mean, spread = F.col(s) / count, F.col(q) - F.col(s) * F.col(s) / count
    sd = F.sqrt(F.when(spread > 1e-12 * F.col(q), spread).otherwise(0.0) / F.nullif(F.col(n) - 1, F.lit(0)))
    gap = F.abs(mean - baseline)
    return F.coalesce((count >= least) & (gap >= MIN_EFFECT) & (gap > led.t_interval(sd, count)), F.lit(False))


STATE = "event_type string, direction string, horizon_days int, condition string, n_keys int, status string, effect double, n long, created timestamp, shadow_from timestamp, active_from timestamp"


def governed_checkpoints(cases: DataFrame, values: Column, baseline: Column, embargo: int = EMBARGO_DAYS, freeze_from: str | None = None, pool: int = 3) -> DataFrame:
    """What every quarter's checkpoint makes of every relationship: checkpoint, keys, n_keys, confirmed (by a test at this
    checkpoint), before, applied, judged, status (after tests, probation and revalidation), effect, n, new_n, all_n,
    created, shadow_from, active_from and version, which counts the changes up to and with this checkpoint.

    cases: event_id, event_type, direction, horizon_days, published_at, realized, may_learn, and what `values` names.
    A case counts from the day on which its outcome is due and the embargo over. At a checkpoint, first, the learnable
    errors that came due in the quarter test their conditions (the last error of each), on cases before that error, with
    Holm by horizon: what is confirmed enters SHADOW, anew or again. Then a relationship in SHADOW with MIN_SHADOW cases
    published since its probation began is ACTIVE or RETIRED by these alone. Then all that is ACTIVE is tested on all its
    cases. From `freeze_from` on nothing is learnt. Null outcomes are none; no cases give no rows."""
    spark = cases.sparkSession
    known = cases.where(F.col("realized").isNotNull())
    listed = stored(hyp.conditions(known, values, pool=pool).select("event_id", "published_at", "realized", "may_learn", *hyp.GROUP, F.col("condition"), F.col("n_keys")), "listed")
    due = lambda at: F.date_add(F.to_date(at), F.col("horizon_days") + embargo)
    quarter_end = F.add_months(F.date_trunc("quarter", due("published_at").cast("timestamp")), 3).cast("timestamp")
    daily = stored(listed.groupBy(*KEYS, F.to_date("published_at").alias("day"), due("published_at").alias("due")).agg(*moments()), "daily")
    errors = hyp.prior_statistics(listed).where("may_learn").withColumn("checkpoint", quarter_end)
    latest = errors.groupBy(*KEYS, "n_keys", "checkpoint").agg(F.max_by(F.struct("event_id", "prior_n", "prior_mean", "prior_sd"), F.struct("published_at", "event_id")).alias("e")).select(*KEYS, "n_keys", "checkpoint", "e.*")
    tests = stored(hyp.hypothesis_tests(latest, baseline, ["checkpoint", "horizon_days"]).where("status = 'CONFIRMED'").select(*KEYS, "n_keys", "checkpoint", "prior_mean", "prior_n"), "tests")
    ends = listed.agg(F.min(quarter_end).alias("a"), F.max(quarter_end).alias("b")).first()
    path = work_dir(spark, "checkpoints")
    out = f"checkpoint timestamp, {STATE.split(', status')[0]}, confirmed boolean, before string, applied string, judged string, {STATE.split('n_keys int, ')[1]}, new_n long, all_n long, version long"
    if ends["a"] is None:
        return spark.createDataFrame([], out)
    steps = [r["t"] for r in spark.sql(f"select explode(sequence(timestamp'{ends['a']}', timestamp'{ends['b']}', interval 3 months)) as t").collect()]
    state, version, versions = spark.createDataFrame([], STATE), 0, []
    for k, at in enumerate(steps):
        if freeze_from and str(at) >= freeze_from:
            break
        now = F.lit(str(at)).cast("timestamp")
        fresh = tests.where(F.col("checkpoint") == now).select(*KEYS, F.col("n_keys").alias("__k"), "prior_mean", "prior_n")
        held = state.join(fresh, [*KEYS], "full").withColumn("confirmed", F.col("prior_n").isNotNull())
        held = held.withColumns({"n_keys": F.coalesce("n_keys", "__k"), "before": F.col("status"), "applied": F.when(F.col("confirmed"), "SHADOW").otherwise(F.col("status")), "effect": F.coalesce("prior_mean", "effect"), "n": F.coalesce("prior_n", "n"), "created": F.coalesce("created", now), "shadow_from": F.coalesce("shadow_from", now)})
        seen = daily.where(F.col("due") <= F.to_date(now)).join(held.select(*KEYS, "shadow_from"), [*KEYS])
        new = F.col("day") >= F.to_date("shadow_from")
        sums = seen.groupBy(*KEYS).agg(*[F.sum(c).alias(f"all_{c}") for c in "nsq"], *[F.coalesce(F.sum(F.when(new, F.col(c))), F.lit(0)).alias(f"new_{c}") for c in "nsq"])
        rows = held.join(sums, [*KEYS], "left").na.fill(0, ["all_n", "new_n"])
        ripe = (F.col("applied") == "SHADOW") & (F.col("new_n") >= MIN_SHADOW)
        rows = rows.withColumn("judged", F.when(ripe, F.when(_holds("new_n", "new_s", "new_q", baseline, MIN_SHADOW), "ACTIVE").otherwise("RETIRED")).otherwise(F.col("applied")))
        stays = _holds("all_n", "all_s", "all_q", baseline, MIN_N)
        rows = rows.withColumn("status", F.when(F.col("judged") == "ACTIVE", F.when(stays, "ACTIVE").otherwise("RETIRED")).otherwise(F.col("judged")))
        # What is active rests on all its cases; what is not keeps the figures it came with.
        live = F.col("status") == "ACTIVE"
        rows = rows.withColumns({"effect": F.when(live, F.col("all_s") / F.nullif(F.col("all_n"), F.lit(0))).otherwise(F.col("effect")), "n": F.when(live, F.col("all_n")).otherwise(F.col("n")), "active_from": F.when(live, F.coalesce(F.when(F.col("before") == "ACTIVE", F.col("active_from")), now))})
        changed = F.col("confirmed") | (F.col("judged") != F.col("applied")) | (F.col("judged") == "ACTIVE")
        seen_now = Observation()
        rows = rows.select(now.alias("checkpoint"), *KEYS, "n_keys", "confirmed", "before", "applied", "judged", "status", "effect", "n", "created", "shadow_from", "active_from", "new_n", "all_n")
        rows.observe(seen_now, F.count(F.when(changed, 1)).alias("n")).write.parquet(f"{path}/step={k}")
        version += seen_now.get["n"]
        versions.append((at, version))
        state = spark.read.schema(rows.schema).parquet(f"{path}/step={k}").select(*[c.split()[0] for c in STATE.split(", ")])
    if not versions:
        return spark.createDataFrame([], out)
    # One version for each quarter of the calendar.
    numbered = spark.createDataFrame(versions, "checkpoint timestamp, version long")
    return spark.read.parquet(path).drop("step").join(F.broadcast(numbered), "checkpoint").select(*[c.split()[0] for c in out.split(", ")])


def active_at(governed: DataFrame, listed: DataFrame) -> DataFrame:
    """Cases (under each condition that they meet) with the relationships that were ACTIVE after the last checkpoint on or
    before their time. Checkpoints are starts of quarters, so cases meet them by equality."""
    known = governed.where("status = 'ACTIVE'").select(F.col("checkpoint").alias("__at"), *KEYS, F.col("effect").alias("effect_estimate"), F.col("n").alias("n_supporting"), "version")
    rows = listed.withColumn("__at", F.date_trunc("quarter", "published_at").cast("timestamp"))
    return rows.join(known, ["__at", *KEYS]).drop("__at")


def governance_log(governed: DataFrame) -> DataFrame:
    """One row per change: checkpoint, keys, action, new_status, promotion_status, effect, n."""
    c = F.col
    item = lambda when, action, new, promotion: F.when(when, F.struct(action.alias("action"), new.alias("new_status"), promotion.alias("promotion_status")))
    text = F.lit
    moves = F.array_compact(F.array(
        item(c("confirmed"), F.when(c("before").isNull(), "CREATE_RELATIONSHIP").otherwise("STRENGTHEN_RELATIONSHIP"), text("SHADOW"), text("SHADOW")),
        item(c("judged") != c("applied"), text("EVALUATE_SHADOW"), c("judged"), F.when(c("judged") == "ACTIVE", "PROMOTED").otherwise("ROLLED_BACK")),
        item(c("judged") == "ACTIVE", text("REVALIDATE_RELATIONSHIP"), c("status"), F.when(c("status") == "ACTIVE", "PROMOTED").otherwise("ROLLED_BACK"))))
    return governed.select("checkpoint", *KEYS, "effect", "n", F.inline(moves))


def scores(rows: DataFrame, keys: Sequence[str] = ("agent", "segment", "horizon_days")) -> DataFrame:
    """Accuracy of scored predictions by agent, segment and horizon."""
    return led.accuracy_metrics(led.outcome_known(rows), keys)
