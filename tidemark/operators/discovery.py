"""The search for setups and conditions under a budget: every test is a row of partial sums, and only what has passed one
gate is looked at by the next.

Budgets are fixed before anything is tested, and written first. Dimensions are those of the library, so the lists of
candidates are small whatever the number of observations; observations themselves are only ever summed up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import chrono_segments, holm, student_p, t_interval
from tidemark.shared import stored

# Gates of every test, segments in order, and by how much of the baseline a setup is given up.
MIN_N, MIN_EFFECT, ALPHA = 15, 0.003, 0.05
SEGMENTS = ("TRAIN", "VALIDATE", "SHADOW", "TEST")
CLEARED = ("TRAIN_SCREENED", "VALIDATED", "SHADOW", "TEST_VALIDATED")
INVALIDATION = 2.0


@dataclass(frozen=True)
class SetupBudget:
    """Caps of a search for setups; which dimensions and candidates come first doesn't depend on outcomes."""

    dimensions: int = 19
    per_combination: int = 2
    combinations: int = 40


@dataclass(frozen=True)
class ResearchBudget:
    """Caps of a search by family, setup and context."""

    families: int = 18
    setups_per_family: int = 4
    contexts_per_setup: int = 3


def recorded(df_of: DataFrame, budget: SetupBudget | ResearchBudget, label: str = "budget") -> DataFrame:
    """(field, cap) of a budget, written to the shared folder before anything is tested."""
    return stored(df_of.sparkSession.createDataFrame([(k, int(v)) for k, v in asdict(budget).items()], "field string, cap long"), label)


def moments(value: str = "realized") -> list[Column]:
    v = F.col(value)
    return [F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")]


def again(prefix: str = "") -> list[Column]:
    return [F.sum(f"{prefix}{c}").alias(c) for c in "nsq"]


def judged(sums: DataFrame, baseline: Column, few: str = "INSUFFICIENT_N") -> DataFrame:
    """Rows of n, s, q (number, sum, sum of squares) as tests of their mean against the baseline: n, mean_effect, ci_low,
    ci_high, p and status. Below MIN_N nothing is tested."""
    # Divisors that are zero give null, as do sums of nothing.
    n, spread = F.col("n"), F.col("q") - F.col("s") * F.col("s") / F.nullif(F.col("n"), F.lit(0))
    sd = F.sqrt(F.when(spread > 1e-12 * F.col("q"), spread).otherwise(0.0) / F.nullif(F.col("n") - 1, F.lit(0)))
    enough = n >= MIN_N
    rows = sums.withColumns({"mean_effect": F.when(enough, F.col("s") / F.nullif(n, F.lit(0))), "__sd": F.when(enough, sd), "__base": baseline})
    gap = F.col("mean_effect") - F.col("__base")
    p = F.when(F.col("__sd") > 0, student_p(gap / F.nullif(F.col("__sd") / F.sqrt(n), F.lit(0.0)), F.nullif(n - 1, F.lit(0)))).when(enough, F.when(gap == 0, 1.0).otherwise(0.0))
    half = t_interval(F.col("__sd"), n)
    status = F.when(~F.coalesce(enough, F.lit(False)), few).when(F.abs(gap) < MIN_EFFECT, "REJECTED_ECONOMICALLY_TRIVIAL").when(F.col("p") < ALPHA, "CONFIRMED").otherwise("REJECTED_NOT_SIGNIFICANT")
    rows = rows.withColumns({"p": p, "ci_low": F.col("mean_effect") - half, "ci_high": F.col("mean_effect") + half})
    return rows.withColumn("status", status).drop("s", "q", "__sd", "__base")


def corrected(tests: DataFrame, family: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """tests with p_holm within their family, and what is confirmed no more with it rejected. Families are as small as the
    budget."""
    rows = holm(tests, family, "p", tie)
    lost = (F.col("status") == "CONFIRMED") & (F.col("p_holm") >= ALPHA)
    return rows.withColumn("status", F.when(lost, "REJECTED_NOT_SIGNIFICANT").otherwise(F.col("status")))


def _of_note(dims: Mapping[str, Sequence[str]], keys: Sequence[str]) -> Column:
    """Array of (dimension, value) of a row's dimensions that show something beyond their defaults."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.col(d), F.lit("UNKNOWN")).isin("UNKNOWN", *skip), F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"))) for d, skip in dims.items()]))


def _meets(condition: Mapping[str, str]) -> Column:
    out = F.lit(True)
    for d, value in condition.items():
        out = out & F.coalesce(F.col(d) == value, F.lit(False))
    return out


def named(condition: Mapping[str, str]) -> str:
    return "&".join(f"{d}={v}" for d, v in condition.items())


def setup_escalation(observed: DataFrame, dims: Mapping[str, Sequence[str]], time_col: str = "as_of", key: str = "observation_id", value: str = "realized", budget: SetupBudget = SetupBudget()) -> DataFrame:
    """One row per candidate setup: its condition, arity, train_baseline, invalidation_pct, and for each segment n, effect,
    p (on TRAIN after Holm) and status, up to the first gate that it doesn't pass; cleared, the last gate that it passed,
    and status TEST_VALIDATED or REJECTED.

    Observations (known outcomes only) are cut into TRAIN, VALIDATE, SHADOW and TEST by time. Dimensions are screened on
    TRAIN against its mean; those confirmed give candidates at their most frequent value (ties: the least), alone and in
    pairs. A later gate is passed where the effect holds against the same baseline, on the same side of it as on TRAIN.
    Two passes over the observations: one for the screening, one for all candidates in all segments. Fewer than MIN_N
    observations on TRAIN, or none screened in, give no rows; null outcomes don't count; ties in time go by the key."""
    rows = stored(chrono_segments(observed.select(key, time_col, value, *dims).where(F.col(value).isNotNull()), time_col, key, list(zip(SEGMENTS, (0.40, 0.30, 0.15, 0.15)))), "observed")
    recorded(observed, budget)
    train = rows.where(F.col("segment") == "TRAIN")
    whole = train.agg(*moments(value)).first()
    if whole["n"] < MIN_N:
        return _no_setups(observed)
    baseline = whole["s"] / whole["n"]
    screened = dict(list(dims.items())[: budget.dimensions])
    values = stored(train.select(value, F.inline(_of_note(screened, []))).groupBy("dimension", "value").agg(*moments(value)), "values")
    families = judged(values.groupBy("dimension").agg(*again()), F.lit(baseline))
    passed = corrected(families, [], ["dimension"]).where("status = 'CONFIRMED'").select("dimension")
    tops = values.join(passed, "dimension").groupBy("dimension").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    top = {r["dimension"]: r["value"] for r in tops.collect()}  # at most one row per dimension of the budget
    found = [d for d in screened if d in top]
    sets = [c for size in range(1, budget.per_combination + 1) for c in combinations(found, size)][: budget.combinations]
    conditions = [{d: top[d] for d in c} for c in sets]
    if not conditions:
        return _no_setups(observed)
    hits = F.array_compact(F.array(*[F.when(_meets(c), F.lit(i)) for i, c in enumerate(conditions)]))
    sums = rows.select("segment", value, F.explode(hits).alias("candidate")).groupBy("candidate", "segment").agg(*moments(value))
    tests = judged(sums, F.lit(baseline))
    on_train = corrected(tests.where("segment = 'TRAIN'"), [], ["candidate"]).withColumn("p", F.col("p_holm")).drop("p_holm")
    tests = on_train.unionByName(tests.where("segment <> 'TRAIN'"))
    one = tests.groupBy("candidate").agg(*[F.max(F.when(F.col("segment") == s, F.struct("n", "mean_effect", "p", "status"))).alias(s) for s in SEGMENTS])
    known = observed.sparkSession.createDataFrame([(i, named(c), len(c)) for i, c in enumerate(conditions)], "candidate int, condition string, arity int")
    side = F.signum(F.col("TRAIN.mean_effect") - baseline)
    same_side = [F.lit(True), *[F.signum(F.col(f"{s}.mean_effect") - baseline) == side for s in SEGMENTS[1:]]]
    out, reached = known.join(one, "candidate", "left"), F.lit(True)
    columns, gates = [], F.lit(0)
    for s, alike in zip(SEGMENTS, same_side):
        low = s.lower()
        columns += [F.when(reached, F.coalesce(F.col(f"{s}.n"), F.lit(0))).alias(f"{low}_n"), F.when(reached, F.col(f"{s}.mean_effect")).alias(f"{low}_effect"), F.when(reached, F.col(f"{s}.p")).alias(f"{low}_p"), F.when(reached, F.coalesce(f"{s}.status", F.lit("INSUFFICIENT_N"))).alias(f"{low}_status")]
        reached = reached & F.coalesce((F.col(f"{s}.status") == "CONFIRMED") & alike, F.lit(False))
        gates = gates + reached.cast("int")
    cleared = F.get(F.array(*[F.lit(c) for c in CLEARED]), gates - 1)
    return out.select("condition", "arity", F.lit(baseline).alias("train_baseline"), F.lit(INVALIDATION * abs(baseline)).alias("invalidation_pct"), *columns, cleared.alias("cleared"), F.when(reached, "TEST_VALIDATED").otherwise("REJECTED").alias("status"))


def _no_setups(df: DataFrame) -> DataFrame:
    parts = ", ".join(f"{s.lower()}_n long, {s.lower()}_effect double, {s.lower()}_p double, {s.lower()}_status string" for s in SEGMENTS)
    return df.sparkSession.createDataFrame([], f"condition string, arity int, train_baseline double, invalidation_pct double, {parts}, cleared string, status string")


def _before_last(rows: DataFrame, keys: Sequence[str], time_col: str, value: str) -> DataFrame:
    """Sums per key over the rows strictly before the key's last time, and their number with it (n_all). The last case is
    the one that a hypothesis comes from, and is no evidence for it."""
    days = rows.groupBy(*keys, time_col).agg(*moments(value), F.count(F.lit(1)).alias("m"))
    last = F.max_by(F.struct("n", "s", "q"), time_col)
    out = days.groupBy(*keys).agg(*[F.sum(c).alias(f"__{c}") for c in "nsq"], F.sum("m").alias("n_all"), last.alias("__last"))
    left = [(F.col(f"__{c}") - F.coalesce(F.col(f"__last.{c}"), F.lit(0))).alias(c) for c in "nsq"]
    return out.select(*keys, "n_all", *left)


def research_tree(cases: DataFrame, dims: Mapping[str, Sequence[str]], contexts: Sequence[str], baseline: Column, groups: Sequence[str] = ("event_type", "direction", "horizon_days"), time_col: str = "published_at", value: str = "realized", budget: ResearchBudget = ResearchBudget()) -> DataFrame:
    """Tests of all levels: groups, level, dimension, value, context, context_value, n, mean_effect, ci_low, ci_high, p,
    p_holm (level 1), status.

    Level 1 pools all values of note of a dimension, its family, over all cases of the group. A family that is confirmed
    after Holm has its most frequent values tested as setups (level 2), a confirmed setup its most frequent value of each
    context (level 3); ties go to the least value. Levels 2 and 3 leave out the last case, from which the hypothesis
    comes. `baseline` is an expression of the groups' columns. All groups are searched at once; a level looks only at the
    cases under what the level before confirmed. Null values are none."""
    families = dict(list(dims.items())[: budget.families])
    recorded(cases, budget)
    long = stored(cases.where(F.col(value).isNotNull()).select(*groups, time_col, value, *contexts, F.inline(_of_note(families, groups))), "families")
    one = corrected(judged(long.groupBy(*groups, "dimension").agg(*moments(value)), baseline, "REJECTED_INSUFFICIENT_N"), groups, ["dimension"])
    one = stored(one, "level1")
    passed = one.where("status = 'CONFIRMED'").select(*groups, "dimension")
    key = [*groups, "dimension", "value"]

    def most_frequent(sums: DataFrame, within: Sequence[str], what: str, most: int) -> DataFrame:
        # Values of a dimension are a short list of the library: a window over them is as small.
        order = F.array_sort(F.collect_list(F.struct((-F.col("n_all")).alias("minus"), F.col(what).alias("v"), "n", "s", "q")))
        return sums.groupBy(*within).agg(F.slice(order, 1, most).alias("top")).select(*within, F.inline("top")).withColumnRenamed("v", what).drop("minus")

    inside = long.join(passed, [*groups, "dimension"], "left_semi")
    two = stored(judged(most_frequent(_before_last(inside, key, time_col, value), [*groups, "dimension"], "value", budget.setups_per_family), baseline, "REJECTED_INSUFFICIENT_N"), "level2")
    held = two.where("status = 'CONFIRMED'").select(*key)
    told = F.inline(F.array(*[F.struct(F.lit(c).alias("context"), F.col(c).alias("context_value")) for c in list(contexts)[: budget.contexts_per_setup]]))
    deep = inside.join(held, key, "left_semi").select(*key, time_col, value, told).where("context_value is not null")
    three = judged(most_frequent(_before_last(deep, [*key, "context", "context_value"], time_col, value), [*key, "context"], "context_value", 1), baseline, "REJECTED_INSUFFICIENT_N")
    none = F.lit(None).cast("string")
    shape = lambda df, level, *have: df.select(*groups, F.lit(level).alias("level"), "dimension", *[F.col(c) if c in have else none.alias(c) for c in ("value", "context", "context_value")], "n", "mean_effect", "ci_low", "ci_high", "p", F.col("p_holm") if level == 1 else F.lit(None).cast("double").alias("p_holm"), "status")
    return shape(one, 1).unionByName(shape(two, 2, "value")).unionByName(shape(three, 3, "value", "context", "context_value"))


