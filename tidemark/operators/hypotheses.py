"""Conditions over market contexts: which cases meet them, tests of them, and predictions from those confirmed.

A condition is a set of at most three (dimension, value) pairs besides type, direction and horizon. Each case is listed
once under every condition it meets, under a text key; so conditions meet cases by equality of keys, and no condition is
compared with every case.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ledger import holm, student_p
from tidemark.operators.scan import known_before, same, statistics, sums_at
from tidemark.shared import stored

CONTEXT = ("regime", "prior_return_bucket", "vol_bucket")
GROUP = ("event_type", "direction", "horizon_days")
#: Supporting cases from which a prediction counts as sure.
SURE = {"HIGH": 50, "MEDIUM": 15}


def known_values(dimensions: Sequence[str], technical: Sequence[str] = (), defaults: dict[str, Sequence[str]] | None = None, most: int = 3) -> Column:
    """`dimension=value` of each context dimension that is known and of the first `most` technical ones, in the order
    given, that show something beyond their default values."""
    def item(d: str, skip: Sequence[str]) -> Column:
        return F.when(~F.coalesce(F.col(d), F.lit("UNKNOWN")).isin(*skip, "UNKNOWN"), F.concat(F.lit(f"{d}="), F.col(d)))

    context = F.array_compact(F.array(*[item(d, ()) for d in dimensions]))
    if not technical:
        return context
    return F.concat(context, F.slice(F.array_compact(F.array(*[item(d, (defaults or {}).get(d, ())) for d in technical])), 1, most))


def conditions(rows: DataFrame, values: Column, arity: int = 3, pool: int = 6, empty: bool = False) -> DataFrame:
    """Each row once for every set of up to `arity` of its values: condition (values joined by &) and n_keys. Sets of no
    value are given only where `empty` says so."""
    picks = [c for size in range(0 if empty else 1, arity + 1) for c in combinations(range(pool), size)]
    sets = F.array(*[F.array(*[F.lit(i) for i in c]) if c else F.array().cast("array<int>") for c in picks])
    fit = F.filter(sets, lambda s: F.coalesce(F.array_max(s), F.lit(-1)) < F.size("__values"))
    keyed = F.transform(fit, lambda s: F.struct(F.array_join(F.transform(s, lambda i: F.get("__values", i)), "&").alias("condition"), F.size(s).alias("n_keys")))
    return rows.withColumn("__values", values).select("*", F.inline(keyed)).drop("__values")


def listed_by_context(rows: DataFrame, dimensions: Sequence[str] = CONTEXT) -> DataFrame:
    """`conditions` of the known values of some dimensions. They are made once for each set of values of these, of which
    there are as many as bins allow, and rows take them by equality; nulls are equal."""
    names = {d: f"__{d}" for d in dimensions}
    contexts = rows.select(*[F.col(d).alias(n) for d, n in names.items()]).distinct()
    values = known_values(dimensions)
    each = conditions(contexts.withColumns({d: F.col(n) for d, n in names.items()}), values, pool=len(dimensions)).drop(*dimensions)
    return rows.join(F.broadcast(each), same(rows, each, names)).drop(*names.values())


def prior_statistics(listed: DataFrame, keys: Sequence[str] = (*GROUP, "condition"), value: str = "realized", time_col: str = "published_at") -> DataFrame:
    """listed with prior_n, prior_mean and prior_sd over rows under the same keys strictly before each row. Sums by time,
    then over times: the pairs of hypothesis and case are never made, and a condition that most cases meet is no hot task."""
    return known_before(listed, listed, list(keys), time_col, value)


def last_errors(cases: DataFrame, period: Column, dimensions: Sequence[str] = CONTEXT, value: str = "realized", time_col: str = "published_at") -> DataFrame:
    """Of each condition's cases in a period that may be learnt from the last, with prior_n, prior_mean and prior_sd over the
    condition's cases strictly before it, as of `prior_statistics`.

    Cases of one context are added up by time, and the last of them picked, before conditions are listed: so a row for each
    context and time is listed, and not one for each case. What earlier periods add up to is carried on over one row per
    condition and period; only cases of its own period are compared with an error's time."""
    group, keys = [*GROUP, *dimensions], [*GROUP, "condition"]
    rows = cases.withColumn("__period", period)

    def last(df: DataFrame, by: list[str]) -> DataFrame:
        rest = F.struct(*[F.col(c) for c in df.columns if c not in (*by, "__period")])
        return df.groupBy(*by, "__period").agg(F.max_by(rest, F.struct(time_col, "event_id")).alias("__row")).select(*by, "__period", "__row.*")

    # Written once: it says up to which time cases count, and takes what they add up to.
    errors = stored(last(listed_by_context(last(rows.where("may_learn"), group), dimensions), keys), "errors")
    sums = sums_at(rows, [*group, "__period"], time_col, value)
    names = {k: f"__k{i}" for i, k in enumerate((*keys, "__period"))}
    upto = errors.select(*[F.col(k).alias(n) for k, n in names.items()], F.col(time_col).alias("__upto"))
    listed = listed_by_context(sums, dimensions)
    added = [F.sum(c).alias(c) for c in "nsq"]
    near = listed.join(upto, same(listed, upto, names) & (listed["__at"] < upto["__upto"])).groupBy(*keys, "__period").agg(*added)
    whole = listed_by_context(sums.groupBy(*group, "__period").agg(*added), dimensions).groupBy(*keys, "__period").agg(*added)
    earlier = Window.partitionBy(*keys).orderBy("__period").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*keys, "__period", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in "nsq"])
    known = near.unionByName(carried).groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(*added)
    known = known.select(*names.values(), *statistics(F.col("n"), F.col("s"), F.col("q")))
    return errors.join(known, same(errors, known, names)).drop("__period", *names.values())


def hypothesis_tests(listed: DataFrame, baseline: Column, batch: Sequence[str], min_n: int = 15, min_effect: float = 0.003, alpha: float = 0.05) -> DataFrame:
    """Hypotheses (rows of `prior_statistics` that may be learnt from) with t, p, p_holm within their batch, and status."""
    gap = F.col("prior_mean") - baseline
    rows = listed.withColumn("gap", gap).withColumn("t", F.when(F.col("prior_sd") > 0, F.col("gap") / (F.col("prior_sd") / F.sqrt("prior_n"))))
    p = F.when(F.col("prior_n") < min_n, None).when(F.col("prior_sd") > 0, student_p(F.col("t"), F.col("prior_n") - 1)).otherwise(F.when(F.col("gap") == 0, 1.0).otherwise(0.0))
    rows = holm(rows.withColumn("p", p), batch, "p", ["event_id", "condition"])
    status = F.when(F.col("prior_n") < min_n, "INSUFFICIENT_N").when(F.abs("gap") < min_effect, "REJECTED_ECONOMICALLY_TRIVIAL").when(F.col("p_holm") < alpha, "CONFIRMED").otherwise("REJECTED_NOT_SIGNIFICANT")
    return rows.withColumn("status", status)


def relationships(tested: DataFrame, keys: Sequence[str] = (*GROUP, "condition", "n_keys"), time_col: str = "published_at") -> DataFrame:
    """One row per confirmed condition: effect and support of its latest confirmation, and when it was first confirmed."""
    last = F.struct(F.col(time_col), F.col("event_id"))
    return tested.where("status = 'CONFIRMED'").groupBy(*keys).agg(F.max_by("prior_mean", last).alias("effect_estimate"), F.max_by("prior_sd", last).alias("effect_sd"), F.max_by("prior_n", last).alias("n_supporting"), F.min(time_col).alias("active_from"), F.count(F.lit(1)).alias("confirmations"))


def applicable(listed: DataFrame, known: DataFrame, time_col: str = "published_at", keys: Sequence[str] = (*GROUP, "condition")) -> DataFrame:
    """Each case with every relationship whose condition it meets and that was active before it. Relationships are one row
    per confirmed condition, so they are what is broadcast: left to itself Spark sent the listed cases, of which it can't
    tell how many sets of values each has."""
    joined = listed.join(F.broadcast(known.drop("n_keys")), [*keys])
    return joined.where(F.col("active_from") < F.col(time_col))


def confidence(n: Column) -> Column:
    case = F
    for label, least in SURE.items():
        case = case.when(n >= least, label)
    return case.otherwise("LOW")


def adaptive_predict(cases: DataFrame, matches: DataFrame, keys: Sequence[str] = ("event_id", "horizon_days")) -> DataFrame:
    """cases (with predicted_impact and predicted_confidence of the baseline model) with those of the best relationship
    in place of them where there is one: the most keys, then the most supporting cases, then the least condition."""
    rank = F.struct((-F.col("n_keys")).alias("a"), (-F.col("n_supporting")).alias("b"), F.col("condition").alias("c"))
    best = matches.groupBy(*keys).agg(F.min_by(F.struct("condition", "effect_estimate", "n_supporting"), rank).alias("best"))
    joined = cases.join(best, [*keys], "left")
    return joined.withColumns({"basis": F.when(F.col("best").isNull(), "unconditional_baseline").otherwise("validated_relationship"), "condition": F.col("best.condition"), "predicted_confidence": F.when(F.col("best").isNull(), F.col("predicted_confidence")).otherwise(confidence(F.col("best.n_supporting"))), "predicted_impact": F.coalesce("best.effect_estimate", "predicted_impact")}).drop("best")


def revalidated(listed: DataFrame, known: DataFrame, baseline: Column, keys: Sequence[str] = (*GROUP, "condition"), value: str = "realized", min_n: int = 15, min_effect: float = 0.003, alpha: float = 0.05) -> DataFrame:
    """Each relationship tested anew on all its cases: ACTIVE where the effect still holds, else RETIRED."""
    out = listed.join(known.select(*keys), [*keys], "left_semi").groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean_effect"), F.stddev_samp(value).alias("sd"))
    gap = F.col("mean_effect") - baseline
    p = F.when(F.col("sd") > 0, student_p(gap / (F.col("sd") / F.sqrt("n")), F.col("n") - 1)).otherwise(F.when(gap == 0, 1.0).otherwise(0.0))
    holds = (F.col("n") >= min_n) & (F.abs(gap) >= min_effect) & (p < alpha)
    return out.withColumn("p", p).withColumn("status", F.when(holds, "ACTIVE").otherwise("RETIRED"))


def shadow_evaluation(listed: DataFrame, known: DataFrame, baseline: Column, until: Column, keys: Sequence[str] = (*GROUP, "condition"), started: str = "active_from", time_col: str = "published_at", least: int = 10) -> DataFrame:
    """Each relationship on probation judged by its cases from its start on and before `until` alone: n of them, their mean
    and outcome. STILL_IN_SHADOW below `least` cases, none included; else ACTIVE where the effect holds on them, or RETIRED."""
    fresh = listed.join(known.select(*keys, F.col(started).alias("__from")), [*keys]).where((F.col(time_col) >= F.col("__from")) & (F.col(time_col) < until))
    judged = revalidated(fresh.drop("__from"), known, baseline, keys).select(*keys, "n", "mean_effect", "status")
    rows = known.select(*keys, started).join(judged, [*keys], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("outcome", F.when(F.col("n") < least, "STILL_IN_SHADOW").otherwise(F.col("status"))).drop("status")
