"""The ledger of predictions and outcomes, and the statistics over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import ranked, running, value_ranks
from tidemark.shared import stored

#: What a score counts as a move, and its chance of being right by confidence.
MOVE = 0.005
CONFIDENCE = {"HIGH": 0.80, "MEDIUM": 0.65, "LOW": 0.55}
REAL_EVENT = ("entity", "published_at", "horizon_days", "event_type", "direction")


def dedupe_real_event(rows: DataFrame, keys: Sequence[str] = REAL_EVENT, by: str = "event_id") -> DataFrame:
    """One row per real event, the least `by` of its rows. The least ones are found over the keys alone, in hash tables that
    hold a row per real event; only rows that have them are packed and sorted. rows is read twice: store what is dear."""
    least = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(by).alias("__least"))
    match = rows[by] == least["__least"]
    for i, k in enumerate(keys):
        match = match & rows[k].eqNullSafe(least[f"__k{i}"])
    packed = F.struct(*rows.columns)
    return rows.join(least, match, "left_semi").groupBy(*keys).agg(F.min_by(packed, by).alias("row")).select("row.*")


def outcome_known(rows: DataFrame) -> DataFrame:
    return rows.where("outcome_status = 'OK' and realized is not null")


def baseline_magnitude(rows: DataFrame, default: float = 0.02) -> DataFrame:
    """(horizon_days, baseline): mean absolute outcome, `default` where none is known."""
    return rows.groupBy("horizon_days").agg(F.coalesce(F.avg(F.abs("realized")), F.lit(default)).alias("baseline"))


def static_predict(rows: DataFrame, baselines: DataFrame) -> DataFrame:
    """rows with predicted_impact (the baseline, signed by direction) and predicted_confidence. One baseline row per
    horizon: Spark broadcasts that table where its size allows."""
    joined = rows.join(baselines, "horizon_days", "left")
    sign = F.when(F.col("direction") == "positive", 1.0).when(F.col("direction") == "negative", -1.0).otherwise(0.0)
    return joined.withColumn("predicted_impact", sign * F.col("baseline")).withColumn("predicted_confidence", F.when(F.col("baseline").isNull(), "INSUFFICIENT_PRECEDENT").otherwise("MEDIUM")).drop("baseline")


def sign(value: Column, least: float = 0.0) -> Column:
    return F.when(value > least, 1).when(value < -least, -1).otherwise(0)


def classify_error(rows: DataFrame) -> DataFrame:
    """rows with error_type, error_value and may_learn."""
    realized, predicted = F.col("realized"), F.col("predicted_impact")
    p, r = sign(predicted), sign(realized, MOVE)
    kind = F.when((F.col("outcome_status") != "OK") | realized.isNull(), "DATA_ERROR").when((F.col("predicted_confidence") == "INSUFFICIENT_PRECEDENT") | predicted.isNull(), "INSUFFICIENT_DATA")
    kind = kind.when((p != 0) & (r != 0) & (p != r), "WRONG_DIRECTION").when(F.abs(realized - predicted) / F.greatest(F.abs(realized), F.lit(MOVE)) > 0.5, "WRONG_MAGNITUDE").otherwise("OK")
    rows = rows.withColumn("error_type", kind)
    return rows.withColumn("error_value", F.when(~F.col("error_type").isin("DATA_ERROR", "INSUFFICIENT_DATA"), realized - predicted)).withColumn("may_learn", F.col("error_type").isin("WRONG_DIRECTION", "WRONG_MAGNITUDE"))


#: Degrees of freedom up to which p is the finite sum; beyond, the normal tail of the transformed t, in fixed steps.
EXACT_DF, STEPS = 1000, 80


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal value: the series of erf below 3, the continued fraction of erfc above."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    start = F.struct(x.alias("term"), x.alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda acc, n: F.struct((acc["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (acc["sum"] + acc["term"] * 2 * x * x / (2 * n + 1)).alias("sum")))["sum"]
    fraction = F.aggregate(F.sequence(F.lit(STEPS), F.lit(1)), F.lit(0.0), lambda acc, n: n / 2 / (x + acc))
    root_pi, bell = F.sqrt(F.lit(3.141592653589793)), F.exp(-x * x)
    return F.when(F.abs(z) < 3, 1 - 2 / root_pi * bell * series).otherwise(bell / root_pi / (x + fraction))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom: the finite trigonometric sum up to EXACT_DF, and beyond
    it the normal tail after the expansion of t in powers of 1 / df, whose error is then below 1e-12. Work and memory
    don't grow with df."""
    df = df.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(df))
    cos2, odd = F.pow(F.cos(theta), 2), F.pmod(df, F.lit(2.0)) == 1
    terms = F.least(F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)), F.lit(EXACT_DF)).cast("int")
    step = lambda k: F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    start = F.struct(F.when(odd, F.cos(theta)).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, lambda acc, k: F.struct((acc["term"] * cos2 * step(k)).alias("term"), (acc["sum"] + F.when(terms >= k, acc["term"]).otherwise(0.0)).alias("sum")))["sum"]
    inside = F.when(odd, 2 / F.lit(3.141592653589793) * (theta + F.sin(theta) * total)).otherwise(F.sin(theta) * total)
    a, b = df - 0.5, 48 * F.pow(df - 0.5, 2)
    w = F.sqrt(a * F.log1p(t * t / df))
    z = w + (F.pow(w, 3) + 3 * w) / b - (4 * F.pow(w, 7) + 33 * F.pow(w, 5) + 240 * F.pow(w, 3) + 855 * w) / (10 * b * (b + 0.8 * F.pow(w, 4) + 100))
    return F.when(df > EXACT_DF, normal_tail(z)).when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))


#: 97.5 % of the normal distribution, and the terms of the expansion of Student's t around it in powers of 1 / df.
Z = 1.959963984540054
QUANTILE = ((Z**3 + Z) / 4, (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96, (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384, (79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160)


def t_interval(sd: Column, n: Column) -> Column:
    """Half the width of the 95 % interval of a mean. The quantile of t is within 2e-5 from 10 values on."""
    df = F.nullif((n - 1).cast("double"), F.lit(0.0))
    t = F.lit(Z)
    for power, term in enumerate(QUANTILE, 1):
        t = t + term / F.pow(df, power)
    return t * sd / F.sqrt(n)


def one_sample_t(rows: DataFrame, keys: Sequence[str], value: str, baseline: Column | float = 0.0, min_n: int = 15, min_effect: float = 0.003, alpha: float = 0.05) -> DataFrame:
    """Per group: n, mean_effect, baseline, t, p, the 95 % interval of the mean and status of the test that the mean differs
    from the baseline. Without spread p is 1 where the mean is the baseline, else 0."""
    base = F.lit(baseline) if isinstance(baseline, float) else baseline
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean_effect"), F.stddev_samp(value).alias("sd"), F.first(base).alias("baseline"))
    gap = F.col("mean_effect") - F.col("baseline")
    out = out.withColumn("t", F.when(F.col("sd") > 0, gap / (F.col("sd") / F.sqrt("n"))))
    out = out.withColumn("p", F.when(F.col("n") < 2, None).when(F.col("sd") > 0, student_p(F.col("t"), F.col("n") - 1)).otherwise(F.when(gap == 0, 1.0).otherwise(0.0)))
    status = F.when(F.col("n") < min_n, "INSUFFICIENT_N").when(F.abs(gap) < min_effect, "REJECTED_ECONOMICALLY_TRIVIAL").when(F.col("p") < alpha, "CONFIRMED").otherwise("REJECTED_NOT_SIGNIFICANT")
    half = F.when(F.col("n") >= 2, t_interval(F.col("sd"), F.col("n")))
    return out.withColumns({"ci_low": F.col("mean_effect") - half, "ci_high": F.col("mean_effect") + half, "status": status})


def holm(rows: DataFrame, family: Sequence[str], p: str, tie: Sequence[str], out: str = "p_holm") -> DataFrame:
    """rows with the Holm step-down p within each family; null p values take no part. For families of a known bound, such
    as the conditions of one batch; `holm_wide` does the same over families of any size."""
    ranks = Window.partitionBy(*family, F.col(p).isNull()).orderBy(p, *tie)
    size = F.count(p).over(Window.partitionBy(*family))
    raw = (size - F.row_number().over(ranks) + 1) * F.col(p)
    steps = rows.withColumn("__raw", raw)
    return steps.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("__raw").over(ranks.rowsBetween(Window.unboundedPreceding, 0))))).drop("__raw")


def holm_wide(rows: DataFrame, family: Sequence[str], p: str, tie: Sequence[str], out: str = "p_holm") -> DataFrame:
    """`holm` by ranges of p: places and running maxima are put together from those of the ranges. Null p come last."""
    sizes = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(family)]).agg(F.count(p).alias("__size"))
    match = F.lit(True)
    for i, k in enumerate(family):
        match = match & rows[k].eqNullSafe(sizes[f"__k{i}"])
    sized = rows.join(sizes, match).drop(*[f"__k{i}" for i in range(len(family))])
    steps = running(sized, list(family), [F.col(p).asc_nulls_last(), *[F.col(c) for c in tie]], {"__place": F.lit(1)}, {"__top": (F.col("__size") - F.col("__place") + 1) * F.col(p)}, label="holm")
    return steps.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("__top")))).drop("__place", "__top", "__size")


def accuracy_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, direction accuracy, MAE, RMSE, rank correlation, Brier score and excluded rows per group."""
    usable = F.col("predicted_impact").isNotNull()
    p, r = sign(F.col("predicted_impact")), sign(F.col("realized"), MOVE)
    chance = F.coalesce(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.col("predicted_confidence")], F.lit(0.5))
    error = F.col("predicted_impact") - F.col("realized")
    # Predictions rest on means, whose last digits vary when they are computed anew; ranks are joined by equal values.
    rows = stored(rows.select(*keys, "predicted_impact", "predicted_confidence", "realized", F.when(usable, F.col("realized")).alias("__r")), "scored")
    for name, col in (("rank_p", "predicted_impact"), ("rank_r", "__r")):
        rows = value_ranks(rows, list(keys), col, name)
    both = usable & (p != 0) & (r != 0)
    out = rows.groupBy(*keys).agg(
        F.count(F.when(usable, 1)).alias("n"), F.count(F.when(~usable, 1)).alias("excluded"),
        F.when(F.count(F.when(both, 1)) >= 2, F.avg(F.when(both, (p == r).cast("double")))).alias("direction_accuracy"),
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when((F.count("rank_p") >= 3) & (F.stddev_pop("predicted_impact") > 1e-12) & (F.stddev_pop("realized") > 1e-12), F.try_divide(F.covar_pop("rank_p", "rank_r"), F.stddev_pop(F.when(usable, F.col("rank_p"))) * F.stddev_pop(F.when(usable, F.col("rank_r"))))).alias("spearman"),
        F.avg(F.when(usable, F.pow(chance - (p == r).cast("double"), 2))).alias("brier"))
    return out.withColumns({c: F.when(F.col("n") >= 2, F.col(c)) for c in ("direction_accuracy", "mae", "rmse", "spearman", "brier")})


def equity_curve(trades: DataFrame, keys: Sequence[str], order: Sequence[str], cost: float = 0.001) -> DataFrame:
    """trades with after_cost, equity (running sum) and drawdown (from the running maximum, at least 0)."""
    out = trades.withColumn("raw_return", sign(F.col("predicted_impact")) * F.col("realized")).withColumn("after_cost", F.col("raw_return") - cost)
    out = running(out, list(keys), [F.col(c) for c in order], {"equity": F.col("after_cost")}, {"__top": F.col("equity")}, label="equity")
    return out.withColumn("drawdown", F.col("equity") - F.greatest(F.lit(0.0), F.col("__top"))).drop("__top")


def portfolio_metrics(trades: DataFrame, keys: Sequence[str], order: Sequence[str], time_col: str = "published_at", cost: float = 0.001) -> DataFrame:
    """Expected value, total, Sharpe, Sortino, drawdown and turnover per group of at least two trades."""
    curve = equity_curve(trades, keys, order, cost)
    a = F.col("after_cost")
    out = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"), F.avg("raw_return").alias("expected_value"), F.avg(a).alias("expected_value_after_costs"), F.sum(a).alias("total_return_after_costs"), F.stddev_samp(a).alias("sd"), F.when(F.count(F.when(a < 0, 1)) >= 2, F.sqrt(F.avg(F.when(a < 0, a * a)))).alias("dd"), F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"), F.greatest(F.lit(1.0), (F.max(F.col(time_col)).cast("double") - F.min(F.col(time_col)).cast("double")) / 86400).alias("window_days"))
    out = out.where("n_trades >= 2").withColumn("trades_per_year", F.col("n_trades") / (F.col("window_days") / 365.25))
    out = out.withColumn("sharpe_per_trade", F.when(F.col("sd") > 0, F.col("expected_value_after_costs") / F.col("sd"))).withColumn("sortino_per_trade", F.when(F.col("dd") > 0, F.col("expected_value_after_costs") / F.col("dd")))
    year = F.sqrt("trades_per_year")
    return out.withColumn("sharpe_annualized", F.col("sharpe_per_trade") * year).withColumn("sortino_annualized", F.col("sortino_per_trade") * year).drop("sd", "dd")


def mode_report(rows: DataFrame, keys: Sequence[str] = ("mode", "horizon_days"), order: Sequence[str] = ("published_at", "event_id")) -> DataFrame:
    """Accuracy and portfolio figures of resolved predictions per mode and horizon. Predictions without an impact are
    counted as excluded and are no trades; modes with fewer than two trades have no portfolio figures."""
    money = portfolio_metrics(rows.where("predicted_impact is not null"), keys, order)
    parts = ["n_trades", "expected_value", "total_return_after_costs", "max_drawdown", "sharpe_per_trade", "sortino_per_trade"]
    other = money.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *parts)
    accuracy, match = accuracy_metrics(rows, keys), F.lit(True)
    for i, k in enumerate(keys):
        match = match & accuracy[k].eqNullSafe(other[f"__k{i}"])
    return accuracy.join(other, match, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def chrono_rank(rows: DataFrame, time_col: str, key: str) -> DataFrame:
    """rows with rn (from 1, by time and key) and total. Counts per day come first; days are then summed in one small
    window, and rows ranked within their day, so no task holds all rows."""
    day = F.to_date(time_col)
    days = rows.groupBy(day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.orderBy("__day")
    days = days.select("__day", F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("total"))
    placed = rows.withColumn("__day", day).join(days, "__day")
    rank = F.row_number().over(Window.partitionBy("__day").orderBy(time_col, key))
    return placed.withColumn("rn", F.col("__before") + rank).drop("__day", "__before")


def chrono_segments(rows: DataFrame, time_col: str, key: str, shares: Sequence[tuple[str, float]] = (("TRAIN", 0.40), ("VALIDATE", 0.30), ("SHADOW", 0.15), ("TEST", 0.15))) -> DataFrame:
    """rows with segment: shares of the rows in order of time, truncated to whole rows; the last takes the rest."""
    out, case, edge = chrono_rank(rows, time_col, key), None, F.lit(0)
    for name, share in shares[:-1]:
        edge = edge + F.floor(F.col("total") * share)
        case = F.when(F.col("rn") <= edge, name) if case is None else case.when(F.col("rn") <= edge, name)
    return out.withColumn("segment", case.otherwise(shares[-1][0])).drop("rn", "total")


def temporal_stability(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Means of the first n // 2 rows and of the rest in time, and whether both are on one side of zero."""
    placed = ranked(rows, [F.col(c) for c in order], "__place", list(keys), "stability")
    sizes = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__size"))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & placed[k].eqNullSafe(sizes[f"__k{i}"])
    first = F.col("__place") <= F.floor(F.col("__size") / 2)
    out = placed.join(sizes, match).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(first, F.col(value))).alias("first_mean"), F.avg(F.when(~first, F.col(value))).alias("second_mean"))
    return out.withColumn("stable", (F.col("first_mean") > 0) == (F.col("second_mean") > 0))


def latest_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sizes: Sequence[int]) -> DataFrame:
    """rows once for each window size that reaches them from the latest row of their group back, with `window`."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = rows.withColumn("__rn", rn).where(F.col("__rn") <= max(sizes))
    return ranked.withColumn("window", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.col("__rn") <= F.col("window")).drop("__rn")
